"""Merkle manifest, sketched near duplicates and ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from trackwise.llm import lexical, manifest, sketching

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id int, node string, _text string, grp string, comp int"
CLASH = (7, "n", "t", "g", 1)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, *CLASH) for i, t, la, s, n in rows], DOCS)


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(i, t, la, s, n):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, la, n, t)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def _steps(levels, at):
    found = []
    for low in levels[:-1]:
        run = low[at // 16 * 16 : at // 16 * 16 + 16]
        found.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return found


def _manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for i, t, la, s, n in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        changed = _leaf(i, t if t is None else t.translate(lower), la, s, n) if bad else None
        by.setdefault(s, []).append((i is not None, i or 0, _leaf(i, t, la, s, n), i, changed))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for at, (_, _, leaf, i, changed) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = _steps(trees[s], at) + _steps(top, g)
            node = changed or leaf
            for a, b in steps:
                node = _h(a + node + b)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], _h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def _ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, f"Text {i} " + "Ü" * rng.randrange(4), "en", "hot", i) for i in range(4500)]  # two superblocks
    rows += [(10_000 + i, None if i % 9 == 0 else f"t{i % 5}", None, f"s{i % 40}", None) for i in range(300)]
    rows += [(None, "No Id", "en", "hot", 1), (None, "No Id", "en", "hot", 1), (3, "Same id", "en", "hot", 1), (20_000, "", "", None, 0), (20_000, "", "", None, 0), (2**60 + 1, "B" * 300_000, "x", "ß", 5)]
    rng.shuffle(rows)
    got = manifest.manifest(manifest.document_leaves(_frame(spark, rows).repartition(5), tampered=manifest.fifth())).collect()
    assert _ordered(got) == _ordered(_manifest(rows))
    assert not all(r["verified"] for r in got)


@pytest.mark.parametrize("rows", [[], [(5, "Only", "en", None, 4)], [(5, "Only", "en", "a", 4), (1, "x", "en", "b", 1)]])
def test_manifest_of_few(spark, rows):
    got = manifest.manifest(manifest.document_leaves(_frame(spark, rows), tampered=manifest.fifth())).collect()
    assert _ordered(got) == _ordered(_manifest(rows))


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _sets(text, size):
    w = _words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def _components(rows, size):
    sets = [_sets(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                comp[top(i)] = top(j)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return [(i, len(sets[x]), least.get(top(x)) if i is not None else None, i is None or i == least[top(x)]) for x, (i, _) in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 120)))) for k in range(150)]
    for base in range(12):  # chains and clusters around the threshold
        text = [word() for _ in range(120)]
        for _ in range(14):
            copy = list(text)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + len(rows), " ".join(copy)))
    rows += [(3000 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(40)]
    rows += [(4000 + k, t) for k, t in enumerate(["a b", "A B", "a", "", None, " \n ", "a b c d", "a b c d e", "b c d e a", "a b c d e f g h i", "a b c d e f g h"])]
    rows += [(None, "a b"), (None, None), (4000, "other words of a repeated id"), (4000, "a b"), (2**60 + 1, " ".join(f"l{k}" for k in range(400_000)))]
    frame = _frame(spark, [(i, t, None, None, None) for i, t in rows]).repartition(3)
    got = sketching.near_duplicates(frame, block=16).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert _ordered(got) == _ordered(_components(rows, 4))


def test_near_duplicates_of_nothing(spark):
    assert sketching.near_duplicates(_frame(spark, [])).collect() == []
    got = sketching.near_duplicates(_frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])).collect()
    assert _ordered(got) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("size", [1, 3, 40, 3000])
def test_sketch_tells_similarity(size):
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 2**63, size).astype(np.uint64) for _ in range(60)]
    b = [np.concatenate([x[: size - size // 9], rng.integers(0, 2**63, size // 9).astype(np.uint64)]) for x in a]
    same = (sketching.sketches(a) == sketching.sketches(b)).mean(1)
    true = (size - size // 9) / (size + size // 9)
    assert abs(same.mean() - true) < 0.02
    assert same.min() * sketching.SIZE >= sketching.LEAST
    one = sketching.sketches([a[0]])[0]
    assert (one == sketching.sketches(a)[0]).all()  # whatever it is sketched with


def _search(rows, items, k=10):
    docs = [(i, lexical.terms_of(t)) for i, t in rows]
    docs = [(i, t) for i, t in docs if t]
    n, total = len(docs), sum(len(t) for _, t in docs)
    queries = {}
    for item, t in items:
        queries.setdefault(item, []).extend(lexical.terms_of(t))
    out = []
    for item, q in queries.items():
        df = {t: sum(t in d for _, d in docs) for t in set(q)}
        found = []
        for i, d in docs:
            m = 25 + (75 * len(d) * n) // total
            s = 0
            for t in q:
                if t in d:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * d.count(t)) // (1000 * d.count(t) + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "of", "ÄRGER", "ärger", f"w{rng.randrange(60)}", f"r{rng.randrange(2000)}"])
    rows = [(k, " ".join(word() for _ in range(rng.choice([3, 3, 3, 20, 20, 200])))) for k in range(500)]
    rows += [(600 + k, "the same text, twice") for k in range(15)] + [(None, "the same text, twice"), (600, "the same text, twice"), (700, None), (701, "--- !"), (702, ""), (2**60 + 1, "w1 " * 5000 + "rare")]
    items = [(k, " ".join(word() for _ in range(30))) for k in range(30)]
    items += [(40, "the same text, twice"), (40, "twice more"), (41, None), (42, "!!"), (43, "unheard-of"), (None, "rare w1"), (2**60 + 3, "ärger of")]
    index = lexical.build(_frame(spark, [(i, t, None, None, None) for i, t in rows]).repartition(3))
    assert index.segments.agg({"n_docs": "sum"}).first()[0] == sum(bool(lexical.terms_of(t)) for _, t in rows)
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, m int, term string")
    assert _ordered(lexical.search(index, bench).collect()) == _ordered(_search(rows, items))
    assert _ordered(lexical.search(index, bench, k=3).collect()) == _ordered(_search(rows, items, 3))


def test_search_in_parts(spark, monkeypatch):
    """Strata of many segments and items in many batches give the same rows."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(12))) for k in range(300)]
    items = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(6))) for k in range(20)]
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 30)
    index = lexical.build(_frame(spark, [(i, t, None, None, None) for i, t in rows]))
    assert index.segments.count() > 10
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert _ordered(got) == _ordered(_search(rows, items))


def test_search_of_nothing(spark):
    empty = _frame(spark, [])
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(lexical.build(empty), one).collect() == []
    assert lexical.search(lexical.build(_frame(spark, [(1, "word", None, None, None)])), none).collect() == []
    assert [tuple(r)[:3] for r in lexical.search(lexical.build(_frame(spark, [(1, "word", None, None, None)])), one).collect()] == [(1, 1, 1)]

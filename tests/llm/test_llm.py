"""The text operators against brute force on small fixtures, with nulls, empty texts, repeats, extra columns and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwise.llm import bytewords, ctw, fingerprint, htmltext, jaccard, langid, packing, piecelattice, quality, tokencount, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, b string, cls string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed, stock=400):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, stock, n)]


def corpus():
    base = words(120, 1)
    near = base[:]
    near[60] = "Changed"
    far = base[:60] + words(60, 2)
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(far), "", None, "one two", "One  two", "x", " \n ", "rep " * 40 + "end",
             "Line of ten words that is long enough to keep.\nSecond line here, also with words.\nLine of ten words that is long enough to keep.", " ".join(words(3000, 5)) + "\n" + "é" * 300,
             "Übung macht den Meister. Größe!\nZweite Zeile hier."]
    rows = [(i, t, "de" if t and "Ü" in t else "en", f"s{i % 2}" if i != 3 else None, len(t or ""), "extra", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes():
    texts = ["a bb  CCC", None, "", "long" * 30 + " a"]
    w = bytewords.Words(texts, lower=True)
    assert [w.of(i) for i in range(len(w.start))] == [b"a", b"bb", b"ccc", b"long" * 30, b"a"]
    assert np.diff(w.first).tolist() == [3, 0, 0, 2]
    h = w.hashes()
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets if d is not None}
    for _ in comp:
        for a in comp:
            for b in comp:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: len(s) for d, s in sets.items()}, comp


def test_jaccard_join(docs, empty):
    sizes, comp = brute_components(corpus())
    got = jaccard.classes(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r.n_shingles == sizes[r.doc_id] and r.component_id == comp.get(r.doc_id)
    assert jaccard.classes(empty).count() == 0
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {None} | set(comp.values())


def test_tiles_split_large_groups(spark):
    base = words(200, 9, 10**6)
    rows = []
    for i in range(60):
        t = base[:]
        for k in range(8):
            t[(i * 7 + k * 23) % 200] = f"edit{i}x{k}"
        rows.append((i, " ".join(t), None, None, None, None, None))
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA), block=8).collect()}
    assert got == brute_components(rows)[1]


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=64, block_windows=4).collect()
    enc = packing.encoder("word_bpe_49k.json").tok
    want = sorted((str(d), bytes(np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, *_ in corpus())
    by_doc, seqs = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for ps in seqs.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *[p.length for p in ps]])[:-1].tolist() and sum(p.length for p in ps) <= 64
    single = {d: b"".join(p.ids for p in sorted(ps, key=lambda r: r.start)) for d, ps in by_doc.items() if d != 0}
    assert sorted((str(d), bytes(v)) for d, v in single.items()) == [w for w in want if w[0] != "0"]
    assert packing.pack(empty).count() == 0
    groups = packing.multiway_difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups) in ([14, 16], [15, 15])


def test_packing_raises_the_count_and_survives_tiny_documents():
    r = np.random.default_rng(2)
    for sizes in ([2100] * 300, [1] * 20_000, [int(x) for x in r.integers(1, 4096, 900)], [4095, 1, 4095], [4095, 2, 4095], [3]):
        windows = packing.pack_block(sizes, 4096)
        assert max(sum(b - a for _, a, b in w) for w in windows) <= 4096
        assert len(windows) <= -(-sum(sizes) // 4096) * 1.02 + 1
        got = sorted(p for w in windows for p in w)
        ends = {i: s for i, s in enumerate(sizes)}
        at = dict.fromkeys(ends, 0)
        for i, a, b in got:
            assert a == at[i]
            at[i] = b
        assert at == ends


def test_clashing_columns(spark):
    rows = [(i, " ".join(words(30, i)), "en", "h", 3, i, "x", "y", "z", 1.5) for i in range(40)] + [(40, " ".join(words(30, 3)), "en", "h", 3, 40, "x", "y", "z", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, _gone string, _id string, lang_pred string, score double")
    for kept in (quality.keep_good(docs), jaccard.keep_one(docs), langid.keep_known(docs)):
        assert kept.columns == docs.columns
        got = {r.doc_id: r for r in kept.collect()}
        assert got[5] == rows[5] and set(range(40)) <= set(got)
    assert 40 not in {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert langid.predict(docs, langid.train(docs)).columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]


def test_token_counts(docs, empty):
    enc, _ = tokencount._encoder("byte_bpe_50k.tiktoken")
    got = tokencount.token_counts(docs).collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    for d, t, *_ in corpus()[1:-2]:
        n = len(enc.encode_ordinary(t or ""))
        assert {r.doc_tokens for r in per[d]} == {n} and sum(r.n_tokens for r in per[d]) == n
        assert [(t or "")[r.char_start : r.char_end] for r in sorted(per[d], key=lambda r: r.section)] == (t or "").split("\n")
    assert tokencount.token_counts(empty).count() == 0
    own, edge = tokencount.attribute(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 6]), np.array([4, 9]))
    assert own.tolist() == [0, 0, 1] and edge.tolist() == [False, True, True]


def test_fingerprints(docs, empty):
    rows = sorted(((d, t or "") for d, t, *_ in corpus() if d is not None), key=lambda x: x[0])
    order = [(None, "no id here at all"), *rows]
    got = fingerprint.fingerprints(docs, buckets=4).collect()
    want = []
    for k, (d, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    text = {d: t for d, t in order}
    for a in got:
        assert 0 <= a.near_edited <= 1 and 0 <= a.near_next <= 1
        for b in got:
            if text[a.doc_id] == text[b.doc_id]:
                assert a.fingerprint == b.fingerprint
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_is_a_multiset(spark):
    rows = spark.createDataFrame([(1, "a b.\nc d.\ne"), (2, "e\na b.\nc d."), (3, "a b.\nc d."), (4, "e")], "k int, t string")
    v = {r.k: r.vec for r in fingerprint.multiset_sums(rows, ["k"], "t").collect()}
    assert v[1] == v[2] != v[3]
    joined = spark.createDataFrame([(v[3], v[4], v[1])], "a array<long>, b array<long>, c array<long>")
    assert joined.select(fingerprint.combine(F.col("a"), F.col("b")) == F.col("c")).first()[0]
    assert joined.select(fingerprint.combine(F.col("c"), F.col("b"), -1) == F.col("a")).first()[0]


def test_quality_rules(docs, empty):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(corpus())
    by = {r.doc_id: r for r in got}
    for d, t, *_ in corpus()[1:]:
        t = t or ""
        w = WORD.findall(t)
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)} if len(w) < 500 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = by[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_symbols) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t)))
        if len(w) < 500:
            assert r.n_repeat_words == len(rep)
            assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    assert quality.quality_rules(empty).count() == 0


def test_boilerplate_depletes(spark):
    line = "This is a common licence line of more than ten words in all."
    rows = [(i, line if i == 0 else line + f"\nand own words number {i} " + " ".join(words(20, i)), None, "h", None, None, None) for i in range(25)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[0] and all(got[i] for i in range(1, 25))
    assert {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()} == set(range(1, 25))


def test_boilerplate_lines_are_taken_out(spark):
    line = "This is a common licence line of more than ten words in all."
    own = [" ".join(words(20, i)) for i in range(25)]
    rows = [(i, f"{own[i]}\n\n {line.upper() if i % 2 else line}\nlast line {i}\n", None, "h", 7, "extra", "clash") for i in range(25)]
    rows.append((25, f"{own[0]}\n{line}\nother host", None, "g", 7, "extra", "clash"))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.keep_good(docs).collect()}
    assert len(got) == 26 and got[25].text == rows[25][1] and got[25].n_chars == 7
    for i in range(25):
        want = f"{own[i]}\n\nlast line {i}\n"
        assert (got[i].text, got[i].n_chars, got[i].b, got[i].cls) == (want, len(want), "extra", "clash")


def test_near_copies_are_left_to_deduplication(spark):
    lines = [" ".join(words(12, 700 + k, 10**6)) for k in range(40)]
    texts = []
    for i in range(100):
        t = lines[:]
        t[(i * 7) % 40] = f"changed line {i}"
        texts.append("\n".join(t))
    cased = ["Some  Words here of a Page that is merely copied with changed case or spaces or ends\nand a Second line of it"] * 2
    texts += [(cased[0].upper() if k % 2 else cased[0]) + " " * k + "\n" * (k // 5) for k in range(50)]
    common = "This is a common licence line of more than ten words in all."
    texts += [common + "\n" + " ".join(words(30, 900 + i, 10**6)) for i in range(25)] + [common]
    docs = spark.createDataFrame([(i, t, None, "h", None, None, None) for i, t in enumerate(texts)], SCHEMA)
    good = quality.keep_good(docs)
    assert {r.doc_id for r in good.collect()} == set(range(175))
    assert {r.doc_id: r.kept for r in quality.quality_rules(docs, near_once=True).collect()} == {i: i < 175 for i in range(176)}
    assert not any(r.kept for r in quality.quality_rules(docs).collect() if r.doc_id < 150)
    left = [r.doc_id for r in jaccard.keep_one(good).collect()]
    assert [i for i in left if i < 100] == [0] and [i for i in left if 100 <= i < 150] == [100] and len(left) == 27


def test_language_id(spark, empty):
    r = np.random.default_rng(3)
    stock = {"en": ["the", "and", "thing", "other", "with"], "fr": ["les", "une", "eaux", "être", "aux"]}
    rows = [(i, " ".join(r.choice(stock[k], 30)), k, None, None, None, None) for i in range(200) for k in [["en", "fr"][i % 2]]]
    rows += [(900, None, "en", None, None, None, None), (901, "123 456", "en", None, None, None, None), (902, "", None, None, None, None, None)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang_pred == ["en", "fr"][i % 2] and 0.5 < got[i].score <= 1 for i in range(200))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert langid.identify(empty).count() == 0


def test_context_tree(docs, empty):
    tree = ctw.build_tree(np.arange(256).clip(0, 63).astype(np.uint8), np.ones(256), [(np.zeros(1, np.int64), np.ones((1, 64)) * 3), (np.array([5]), np.ones((1, 64)))])
    assert np.allclose((10.0**tree.log10).sum(1), 1, atol=1e-4)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*WORD.findall((t or "").translate(LOW)), "\n"]) for d, t, *_ in corpus()]
    c = {}
    for d, ws in toks:
        for w in ws if not held(d) else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    got = ctw.score(docs).collect()
    want = sorted((str(d), len(ws), sum(w in c for w in ws), round(sum(np.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in toks)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert ctw.score(empty).count() == 0


def brute_levels(text, least):
    """By depth, the contexts (newest symbol lowest) seen at least ``least`` times and their symbol counts; a byte is its own symbol."""
    b = [ctw.OTHER] * ctw.DEPTH + text + [ctw.OTHER]
    levels = []
    for d in range(ctw.DEPTH + 1):
        seen = {}
        for i in range(ctw.DEPTH, len(b)):
            seen.setdefault(sum(b[i - k] * ctw.CLASSES ** (k - 1) for k in range(1, d + 1)), np.zeros(ctw.CLASSES))[b[i]] += 1
        kept = sorted(c for c, n in seen.items() if d == 0 or n.sum() >= least)
        levels.append((np.array(kept, np.int64), np.array([seen[c] for c in kept])))
    return levels


def test_context_walk_ends_at_a_missing_node():
    r = np.random.default_rng(4)
    classes = np.arange(256).clip(0, ctw.OTHER).astype(np.uint8)
    train = [int(x) for x in r.choice(6, 3000, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02])]
    levels = brute_levels(train, 12)
    tree = ctw.build_tree(classes, np.bincount([*train, ctw.END], minlength=256).astype(float), levels)
    where = [{int(c): i for i, c in enumerate(codes)} for codes, _ in levels]
    start = np.cumsum([0, *map(len, where)])
    texts = [[int(x) for x in r.integers(0, 8, 60)] for _ in range(20)]
    ended = 0
    for t in texts:
        b, want = [ctw.OTHER] * ctw.DEPTH + t + [ctw.OTHER], 0.0
        for i in range(ctw.DEPTH, len(b)):
            d = 0
            while d < ctw.DEPTH and sum(b[i - k] * ctw.CLASSES ** (k - 1) for k in range(1, d + 2)) in where[d + 1]:
                d += 1
            ended += d < ctw.DEPTH
            node = start[d] + where[d][sum(b[i - k] * ctw.CLASSES ** (k - 1) for k in range(1, d + 1))]
            want += float(tree.log10[node, b[i]])
        want += float(tree.other[ctw.END])
        assert abs(tree.score([bytes(t).decode()])[0] - want) < 1e-3
    assert ended > 100


def brute_ctw(train, texts):
    """log10 probability of each text by ratios of the root's weighted probability, every byte context kept."""
    from collections import Counter
    from math import exp, lgamma, log, log1p

    def runs(t):
        b = b"\xff" * ctw.DEPTH + (t or "").translate(LOW).encode() + b"\xff"
        return [b[i - ctw.DEPTH : i + 1] for i in range(ctw.DEPTH, len(b))]

    path = lambda s: [((1 << k) | (s >> (8 - k)), (s >> (7 - k)) & 1) for k in range(8)]
    n = {}
    for r, c in Counter(r for t in train for r in runs(t)).items():
        for dec, bit in path(r[-1]):
            for d in range(ctw.DEPTH + 1):
                n.setdefault((r[ctw.DEPTH - d : ctw.DEPTH], dec), [0, 0])[bit] += c
    pe = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(np.pi)
    half = lambda x, y: max(x, y) + log1p(exp(-abs(x - y))) - log(2)
    pw, below = {}, {}
    for ctx, dec in sorted(n, key=lambda k: -len(k[0])):
        own = pe(*n[ctx, dec])
        pw[ctx, dec] = own if len(ctx) == ctw.DEPTH else half(own, below[ctx, dec])
        if ctx:
            below[ctx[1:], dec] = below.get((ctx[1:], dec), 0.0) + pw[ctx, dec]

    def bit_log(ctx5, dec, bit):
        new = 0.0
        for d in range(ctw.DEPTH, -1, -1):
            key = (ctx5[ctw.DEPTH - d :], dec)
            a = list(n.get(key, (0, 0)))
            a[bit] += 1
            deeper = (ctx5[ctw.DEPTH - d - 1 :], dec)
            new = pe(*a) if d == ctw.DEPTH else half(pe(*a), below.get(key, 0.0) - pw.get(deeper, 0.0) + new)
        return new - pw.get((b"", dec), 0.0)

    return [sum(bit_log(r[:-1], dec, bit) for r in runs(t) for dec, bit in path(r[-1])) / log(10) for t in texts]


def test_context_tree_keeps_every_context(spark):
    r = np.random.default_rng(8)
    texts = ["ab" * 350_000 + "".join(chr(x) for x in r.integers(97, 123, 300)), None, "", "Rare zqu words, " * 2]
    texts += ["".join(chr(x) for x in r.integers(*span, 40)) for span in [(0x4E00, 0x4E20), (0x3B1, 0x3C9), (0x410, 0x450), (97, 105)] * 5]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    assert any(held[4:]) and not held[0]
    want = brute_ctw([t for t, h in zip(texts, held, strict=True) if not h], texts[1:])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in ctw.score(rows).collect()}
    assert len(got) == len(texts) and np.allclose([got[i] for i in range(1, len(texts))], want, atol=1e-3, rtol=1e-5)


def brute_pieces(text, table, longest, least):
    """Ids of the best path over the whole marked text, without any cut into segments."""
    t = piecelattice.MARK + text.replace(" ", piecelattice.MARK)
    best, back = [0.0], [None]
    for e in range(1, len(t) + 1):
        options = []
        for n in range(1, min(longest, e) + 1):
            hit = table.get(t[e - n : e])
            if hit or n == 1:
                options.append((best[e - n] + (hit[1] if hit else least - piecelattice.UNKNOWN), -n, hit[0] if hit else None))
        total, n, i = max(options, key=lambda o: (o[0], o[1]))
        best.append(total)
        back.append((-n, i))
    out, e = [], len(t)
    while e:
        n, i = back[e]
        out += [i] if i is not None else [b + piecelattice.FIRST_BYTE for b in reversed(t[e - 1].encode())]
        e -= n
    return out[::-1]


def test_lattice_takes_the_best_path(spark, docs, empty):
    rows, longest = piecelattice.pieces(spark, "piece_bpe_32k.model")
    table, least = {p: (i, v) for p, i, v in rows}, min(r[2] for r in rows)
    texts = [t for _, t, *_ in corpus()] + ["a" * 700, "日本語のテキスト。漢字 123 abc,def! \U0001f600", "  two  spaces\n\nx"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts[-3:], 100)), "doc_id long, text string"))
    got = piecelattice.encode(more).collect()
    want = sorted((str(d), brute_pieces(t, table, longest, least) if t else []) for d, t in [*[(r[0], r[1]) for r in corpus()], *enumerate(texts[-3:], 100)])
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert piecelattice.encode(empty).count() == 0
    assert piecelattice.cut_of(["ab"]) == piecelattice.FINE and piecelattice.cut_of(["a1"]) == piecelattice.COARSE


def test_long_segments_in_blocks(spark):
    rows, longest = piecelattice.pieces(spark, "piece_bpe_32k.model")
    r = np.random.default_rng(3)
    segs = ["a" * 37, "日本語のテキスト漢字" * 5, "".join(r.choice(list("abcdehilmnorst"), 200)), "\U0001f600é" * 20, "x", "internationalization" * 9, "ab" * 8]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(segs)], "seg string, n long")
    want = {(x.seg, x.n): x.ids for x in piecelattice.encode_segments(df, rows, longest).collect()}
    for block in (8, 16, 512):  # below, at and above the longest piece
        assert {(x.seg, x.n): x.ids for x in piecelattice.encode_long(df, rows, longest, block).collect()} == want


def test_text_without_a_break_takes_time_by_its_length(spark):
    text = "q" * 200_000 + "漢" * 3000 + " " * 1000 + "end"
    row = piecelattice.encode(spark.createDataFrame([(1, text), (2, text), (3, "end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(x.round_trip for x in row) and row[0].ids == row[1].ids and len(row[2].ids) < 3 < len(row[0].ids) // 1000


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>A head &amp; more</h1><p><b>First  text\nhere, of some length.<br><p>Second one.</p></article><div class='comments'><p>I do agree with that.</p></div><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page if i < 3 else None) for i in range(4)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages, layouts=300).collect()}
    assert got[0] == "A head & more\nFirst text here, of some length.\nSecond one." and got[3] == ""
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_viterbi_is_the_best_labelling():
    from itertools import product

    crf = htmltext.Crf({}, np.array([0.1, -0.2]), np.array([[0.5, -1.0], [-0.3, 0.8]]))
    s = [0.4, -0.7, 1.2, -0.1, 0.3]
    value = lambda y: crf.first[y[0]] + sum(v for v, k in zip(s, y, strict=True) if k) + sum(crf.pair[a, b] for a, b in zip(y, y[1:]))
    assert tuple(crf.decode(s)) == max(product((0, 1), repeat=5), key=value)


def test_warc_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} {'y' * 50}</p>") for i in range(300)] + [(None, None, None), (7, "http://x/7b", "twice")], "page_id long, url string, html string")
    a = warc.from_pages(pages)
    assert warc.audit(a, a).count() == 0
    hurt = warc.damaged(pages)
    got = {r.page_id: r.status for r in warc.audit(a, warc.from_pages(hurt)).collect()}
    want = {i: {0: "changed", 1: "changed", 2: "missing"}[r] for i in range(300) if (r := zlib.crc32(str(i).encode()) % 29) < 3}
    assert got == want
    raw = b"".join(bytes(r.record, "utf-8") for r in a.orderBy("id", "url").collect())
    (tmp_path / "a.warc").write_bytes(raw)
    back = warc.read_warc(spark, str(tmp_path / "a.warc")).orderBy("offset").collect()
    assert len(back) == 302 and sum(r.length for r in back) == len(raw) and bytes(back[5].payload).startswith(b"<p>page 4")


def test_pieces_left_out_are_on_no_best_path():
    import itertools
    import random

    def best(text: str, table: dict[str, float]) -> tuple[float, list[str]]:
        # the greatest sum; of equal sums the path that ends in the shortest piece
        found = [(0.0, [])]
        for e in range(1, len(text) + 1):
            options = [(found[e - n][0] + table[text[e - n : e]], -n) for n in range(1, e + 1) if text[e - n : e] in table]
            total, n = max(options)
            found.append((total, [*found[e + n][1], text[e + n : e]]))
        return found[-1]

    r = random.Random(5)
    left_out = 0
    for _ in range(30):
        every = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)]
        rows = [(p, i, -float(r.randint(1, 12))) for i, p in enumerate(every) if len(p) == 1 or r.random() < 0.5]
        kept = piecelattice.used(rows)
        left_out += len(rows) - len(kept)
        whole, few = ({p: s for p, _, s in x} for x in (rows, kept))
        for _ in range(40):
            text = "".join(r.choices("ab", k=r.randint(1, 12)))
            assert best(text, whole) == best(text, few)
    assert left_out > 50

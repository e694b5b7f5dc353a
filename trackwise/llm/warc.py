"""WARC records and a Merkle fixity audit of replicas.

Records are hashed; the hashes of a file's records, ordered by their place, form a tree
of ``FANOUT`` children a node, each node with the byte range of its records. The roots
of two replicas are compared first, then, level by level, only the children of nodes
that differ, until the differing records are left: changed, missing or extra, with their
byte ranges in either replica.

A record's place in its file is its slot (record number of the id), so a lost record
moves no other record to another slot, though it moves their offsets; hashes therefore
cover content and length, not offsets. Records that share a slot are hashed together.

Defined results: null html is an empty payload, a null url an empty one; records without
id stand in file -1; replicas that agree, and empty tables, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackwise.llm.text import cut_lineage

FANOUT = 16
PER_FILE = FANOUT**3
LEVELS = 3


def record(url: Column, payload: Column) -> Column:
    """A resource record: header, blank line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def from_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``file slot id url record``: pages as WARC records, ``PER_FILE`` ids to a file."""
    i = F.col(page_id).cast("long")
    return pages.select(
        F.coalesce(F.floor(i / PER_FILE), F.lit(-1)).cast("long").alias("file"), F.coalesce(F.pmod(i, F.lit(PER_FILE)), F.lit(0)).cast("long").alias("slot"),
        i.alias("id"), F.col(url).alias("url"), record(F.col(url), F.col(html)).alias("record"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file_path offset length header payload`` of the records of WARC files, plain or gzip by record; bad records end their file's reading with an error row whose header is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
            if data[:2] != b"\x1f\x8b":
                yield 0, len(data), data
                return
            at = 0
            while at < len(data):
                d = zlib.decompressobj(31)
                out = d.decompress(data[at:]) + d.flush()
                used = len(data) - at - len(d.unused_data)
                yield at, used, out
                at += used

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for base, size, raw in members(bytes(data)):
                    at = 0
                    while at < len(raw):
                        head_end = raw.find(b"\r\n\r\n", at)
                        head = raw[at:head_end].decode("utf-8", "replace") if head_end >= 0 else ""
                        n = next((x.split(":", 1)[1].strip() for x in head.split("\r\n") if x.lower().startswith("content-length:")), "")
                        if not head.startswith("WARC/") or not n.isdigit():
                            rows.append((p, base + at, len(raw) - at, None, None))
                            break
                        start, stop = head_end + 4, head_end + 4 + int(n)
                        end = stop + 4 if raw[stop : stop + 4] == b"\r\n\r\n" else stop
                        zipped = size != len(raw)
                        rows.append((p, base if zipped else base + at, size if zipped else end - at, head, raw[start:stop]))
                        at = end
                yield pd.DataFrame(rows, columns=["file_path", "offset", "length", "header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file_path string, offset long, length long, header string, payload binary")


def leaves(records: DataFrame) -> DataFrame:
    """``file slot id url start stop hash``: one row per slot, byte ranges in slot order; only hashes and lengths are shuffled."""
    each = records.select("file", "slot", "id", "url", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("h"))
    slots = each.groupBy("file", "slot").agg(
        F.min("id").alias("id"), F.min("url").alias("url"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.min("h").alias("one"), F.sha2(F.concat_ws(",", F.count("*"), F.bit_xor(F.xxhash64("h")), F.sum(F.xxhash64("h", F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1)))), 256).alias("many"),
    )
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slots.select("file", "slot", "id", "url", before.alias("start"), (before + F.col("n")).alias("stop"), F.when(F.col("k") == 1, F.col("one")).otherwise(F.col("many")).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up, from ``file at start stop hash``; at most FANOUT children each."""
    up = nodes.groupBy("file", F.floor(F.col("at") / FANOUT).cast("long").alias("up")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("c"),
    )
    text = F.array_join(F.transform("c", lambda x: F.concat((x["at"] % FANOUT).cast("string"), F.lit(":"), x["hash"])), ",")
    return up.select("file", F.col("up").alias("at"), "start", "stop", F.sha2(text, 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """The levels of every file's tree, leaves first, the root (``at`` 0) last."""
    low = cut_lineage(leaves(records))
    levels = [low.withColumnRenamed("slot", "at")]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1].select("file", "at", "start", "stop", "hash")))
    return levels


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where the records of replica ``b`` differ from those of ``a`` (both ``file slot id url record``): one row per record, with its byte ranges."""
    ta, tb = tree(a), tree(b)
    differing = None
    for k in range(LEVELS, -1, -1):
        x, y = (
            t[k].select("file", "at", *([F.col("id").alias(f"id_{s}"), F.col("url").alias(f"url_{s}")] if k == 0 else []), F.col("start").alias(f"start_{s}"), F.col("stop").alias(f"stop_{s}"), F.col("hash").alias(f"hash_{s}"))
            for t, s in ((ta, "a"), (tb, "b"))
        )
        if differing is not None:
            below = differing.select("file", F.col("at").alias("up"))
            x, y = (z.withColumn("up", F.floor(F.col("at") / FANOUT).cast("long")).join(below, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        differing = x.join(y, ["file", "at"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return differing.select(
        "file", F.col("at").alias("slot"), F.coalesce("id_a", "id_b").alias("page_id"), F.coalesce("url_a", "url_b").alias("url"), status.alias("status"),
        "start_a", "stop_a", "start_b", "stop_b", "hash_a", "hash_b",
    )


def damaged(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", mod: int = 29) -> DataFrame:
    """A replica of ``pages`` with planted damage by crc32 of the id: remainder 0 one changed sign, 1 a lost end, 2 a lost page."""
    r = F.coalesce(F.crc32(F.col(page_id).cast("string").cast("binary")) % mod, F.lit(mod))
    h = F.coalesce(F.col(html), F.lit(""))
    middle = F.floor(F.char_length(h) / 2).cast("int")
    flipped = F.concat(h.substr(F.lit(1), middle), F.lit("¤"), h.substr(middle + 2, F.char_length(h)))
    cut = h.substr(F.lit(1), F.greatest(F.char_length(h) - 10, F.lit(0)))
    return pages.filter(r != 2).withColumn(html, F.when(r == 0, flipped).when(r == 1, cut).otherwise(h))


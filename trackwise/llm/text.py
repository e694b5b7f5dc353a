"""Word rules and small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is the space and the control characters 09-0D; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it, inside one expression."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of words of a text; empty for null or blank texts."""
    cut = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(cut, lambda w: w != "")


def light(spark: SparkSession) -> None:
    """Keep the batches sent to Python below ``BATCH_BYTES``, so that runs of very long texts do not fill a worker's memory; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slim(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, its freed memory given back to the system at its end: Python workers outlive a stage and share their executor's memory."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        yield from run(batches)
        pyarrow.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries keep it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; on one machine, where it is unset, a temporary folder. A cluster without it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed columnar table in the shared checkpoint folder: less disk than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

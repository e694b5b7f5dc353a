"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; on one machine, where it is unset, a temporary folder. A cluster without it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-shared-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and what reads it outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def static(df: DataFrame) -> DataFrame:
    """A map's table, computed once: as small as the map, it is held on the driver and planned as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


#: Rows up to which a map's derived table is held on the driver.
HELD_ROWS = 50_000


def held(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame:
    """A derived table, computed once: a local relation of at most ``limit`` rows, else a table in the shared folder."""
    some = df.limit(limit + 1).toArrow()
    return df.sparkSession.createDataFrame(some, df.schema) if some.num_rows <= limit else kept(df)


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """``df`` dealt by ``keys`` to a fixed number of partitions (``times`` as many where tasks are long), before a join that multiplies its rows: adaptive coalescing sees only the small input and would put it all in one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n * times, *keys)

"""Readers and writers of the engine's tables: tracks, metadata, configs, occlusion stores, samples, predictions, models."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the recordings' CSV files.
TRACKS = T.StructType([
    T.StructField("recordingId", T.StringType()), T.StructField("trackId", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("trackLifetime", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("xCenter", "yCenter", "heading", "width", "length", "xVelocity", "yVelocity", "xAcceleration", "yAcceleration", "lonAcceleration", "latAcceleration")],
])
TRACK_META = T.StructType([
    T.StructField("recordingId", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("trackId", "initialFrame", "finalFrame", "numFrames")],
    T.StructField("width", T.DoubleType()), T.StructField("length", T.DoubleType()), T.StructField("class", T.StringType()),
])
RECORDING_META = T.StructType([
    T.StructField("recordingId", T.StringType()), T.StructField("locationId", T.IntegerType()), T.StructField("frameRate", T.DoubleType()), T.StructField("startTime", T.DoubleType()),
    T.StructField("duration", T.DoubleType()), T.StructField("numVehicles", T.IntegerType()), T.StructField("xUtmOrigin", T.DoubleType()), T.StructField("yUtmOrigin", T.DoubleType()), T.StructField("orthoPxToMeter", T.DoubleType()),
])
# Classes of the recordings and the engine's names for them.
CLASSES = {"car": "car", "Car": "car", "van": "truck_bus", "truck": "truck_bus", "bus": "truck_bus", "Bus": "truck_bus", "truck_bus": "truck_bus", "Medium Vehicle": "truck_bus", "Heavy Vehicle": "truck_bus", "bicycle": "bicycle", "Bicycle": "bicycle", "pedestrian": "pedestrian", "Pedestrian": "pedestrian"}


def class_name(raw: Column) -> Column:
    """The engine's class; an unknown one raises."""
    known = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return F.coalesce(known[raw], F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(raw, F.lit("null")))).cast("string"))


def recording_id() -> Column:
    """The recording's id from its file's name, e.g. ``07_tracks.csv``."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)_[A-Za-z]+\.csv[^/]*$", 1)


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's columns by their names in each file's header, whatever their order; those a file lacks are null.

    The headers are read first, one line a file, by tasks; files of one header are then read together, so that as many
    reads are planned as there are different headers. ``recordingId`` falls back to the file's name, ``_row`` orders
    the rows as they stand in the files.
    """
    lines = spark.read.text(path).select(F.col("value").alias("header"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    headers = lines.filter(F.col("at") == 0).groupBy("file").agg(F.min_by("header", "n").alias("header")).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    parts = []
    for h in headers.toLocalIterator():  # a row per different header
        raw = spark.read.option("header", True).csv([unquote(f) for f in h["files"]])
        there = set(raw.columns)
        cols = [(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        named = raw.select(*cols, recording_id().alias("_file"), F.monotonically_increasing_id().alias("_row"))
        parts.append(named.withColumn("recordingId", F.coalesce("recordingId", "_file")).drop("_file"))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_row", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track states of one or many recordings (a glob), headings in radians; the recording id falls back to the file's name."""
    return _csv(spark, path, TRACKS).select(
        F.col("recordingId").alias("recording_id"), F.col("trackId").alias("agent_id"), F.col("frame").alias("frame_id"), F.col("trackLifetime").alias("track_lifetime"),
        F.col("xCenter").alias("x"), F.col("yCenter").alias("y"), F.radians("heading").alias("heading"), "width", "length",
        F.col("xVelocity").alias("vx"), F.col("yVelocity").alias("vy"), F.col("xAcceleration").alias("ax"), F.col("yAcceleration").alias("ay"), F.col("lonAcceleration").alias("lon_acc"), F.col("latAcceleration").alias("lat_acc"),
    )


def read_track_meta(spark: SparkSession, path: str) -> DataFrame:
    """Life span, size and class of each track."""
    return _csv(spark, path, TRACK_META).drop("_row")


def read_recording_meta(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each recording's metadata."""
    rows = _csv(spark, path, RECORDING_META)
    first = rows.groupBy("recordingId").agg(F.min_by(F.struct(*RECORDING_META.fieldNames()), "_row").alias("r"))
    return first.select("r.*")


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """States of all recordings of a folder with their metadata, joined by recording and track."""
    tracks = read_tracks(spark, f"{folder}/*_tracks.csv")
    meta = read_track_meta(spark, f"{folder}/*_tracksMeta.csv").select(F.col("recordingId").alias("recording_id"), F.col("trackId").alias("agent_id"), F.col("class").alias("_class"))
    rec = read_recording_meta(spark, f"{folder}/*_recordingMeta.csv").select(F.col("recordingId").alias("recording_id"), F.col("frameRate").alias("fps"))
    return tracks.join(meta, ["recording_id", "agent_id"], "left").join(rec, "recording_id", "left").withColumn("agent_type", F.when(F.col("_class").isNotNull(), class_name(F.col("_class")))).drop("_class")


CONFIG = T.StructType([
    T.StructField("scenario", T.StringType()), T.StructField("goals", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("goal_types", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("goals_priors", T.ArrayType(T.DoubleType())), T.StructField("goal_threshold", T.DoubleType()), T.StructField("reachable_pairs", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("cost_factors", T.MapType(T.StringType(), T.DoubleType())), T.StructField("buildings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
])


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Scenario configs, one JSON document a file; the scenario falls back to the file's name."""
    c = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    return c.withColumn("scenario", F.coalesce("scenario", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json[^/]*$", 1)))


def config_goals(config: DataFrame) -> DataFrame:
    """``scenario goal_idx x y threshold``; the place in the list is the goal's number."""
    return config.select("scenario", F.coalesce("goal_threshold", F.lit(1.5)).alias("threshold"), F.posexplode("goals").alias("goal_idx", "g")).select("scenario", "goal_idx", F.col("g")[0].alias("x"), F.col("g")[1].alias("y"), "threshold")


def config_goal_types(config: DataFrame) -> DataFrame:
    return config.select("scenario", F.posexplode("goal_types").alias("goal_idx", "ts")).select("scenario", "goal_idx", F.explode("ts").alias("goal_type"))


def config_buildings(config: DataFrame) -> DataFrame:
    ring = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return config.select("scenario", F.posexplode("buildings").alias("building_id", "r")).select("scenario", "building_id", ring.alias("ring"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``scenario subset episode`` from one nested JSON document."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return text.select(F.explode("m").alias("scenario", "s")).select("scenario", F.explode("s").alias("subset", "e")).select("scenario", "subset", F.explode("e").alias("episode"))


RINGS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))


def rings_from_json(text: Column) -> Column:
    """frame -> ego -> rings, each ring [[x, ...], [y, ...]]."""
    return F.from_json(text, RINGS)


def exploded_rings(store: DataFrame, col: str) -> DataFrame:
    """Flat ``frame_id ego_id ring_id ring`` rows; keys are strings in JSON."""
    rows = store.select(F.explode(col).alias("f", "egos")).select("f", F.explode("egos").alias("e", "rings")).select("f", "e", F.posexplode("rings").alias("ring_id", "r"))
    ring = F.transform(F.arrays_zip(F.col("r")[0].alias("x"), F.col("r")[1].alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return rows.select(F.col("f").cast("long").alias("frame_id"), F.col("e").cast("long").alias("ego_id"), "ring_id", ring.alias("ring"))


def rings_to_json(rows: DataFrame) -> DataFrame:
    """One JSON text per frame, ``{frame: {ego: [[[x...],[y...]], ...]}}``, from flat rows."""
    ring = F.array(F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"]))
    egos = rows.groupBy("frame_id", "ego_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", ring.alias("r")))), lambda z: z["r"]).alias("rings"))
    frames = egos.groupBy("frame_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("ego_id").cast("string").alias("k"), "rings")))).alias("egos"))
    return frames.select("frame_id", F.to_json(F.create_map(F.col("frame_id").cast("string"), "egos")).alias("json"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet by scenario and episode, so that a split reads its own folders only.

    Only the episodes that ``samples`` has are replaced: episodes can be added one by one, and writing one again changes nothing else.
    """
    by_episode = samples.repartition("scenario", "episode", F.pmod(F.xxhash64("agent_id"), F.lit(16)))  # at most 16 files an episode
    by_episode.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario", "episode").parquet(path)


def read_samples(spark: SparkSession, path: str, splits: DataFrame, subset: str, columns: list[str] | None = None) -> DataFrame:
    """Samples of a subset's episodes; with ``columns`` only those, without repeats."""
    wanted = splits.filter(F.col("subset") == subset).select("scenario", "episode").distinct()
    rows = spark.read.parquet(path).join(F.broadcast(wanted), ["scenario", "episode"], "left_semi")  # a row per episode
    return rows.select(*columns).distinct() if columns else rows


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Predictions or metrics, one long table by scenario."""
    metrics.write.mode("overwrite").partitionBy("scenario").parquet(path)


def write_model(nodes: DataFrame, priors: DataFrame, path: str) -> None:
    """Trees and priors are tables of their own."""
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    priors.coalesce(1).write.mode("overwrite").parquet(f"{path}/priors")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/priors")

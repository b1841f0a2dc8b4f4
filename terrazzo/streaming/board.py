"""A board of metrics that follows its files: a file stream, and a store that batches replace scenes in.

Each trigger reads the metric files that are new since the last one and writes their rows to a folder of
the store that its number names. A batch that comes again, after a failure, writes the same folder
again, so it changes nothing; what a scene had in earlier batches is superseded as a whole by its rows
in a later one. A file that can't be read is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrazzo.operators.metrics import dashboard

ROWS = "side string, file string, modified timestamp, corrupt string, scene string, name string, value double"


def metric_updates(spark: SparkSession, path: str, sides: tuple[str, str] = ("before", "after"), files_per_trigger: int | None = None) -> DataFrame:
    """ROWS of metric files {scene: {name: number}} as a stream; a file's side is the folder that it lies under.

    The key mean is no scene. Other JSON, and text that is none, gives the text in `corrupt`.
    """
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    side = F.regexp_extract("file", "/(" + "|".join(sides) + ")/", 1)
    parsed = raw.select(side.alias("side"), "file", "modified", F.from_json("value", "map<string, map<string, double>>").alias("m"), "value").where(F.col("side") != "")
    rows = parsed.select("side", "file", "modified", F.when(F.col("m").isNull(), F.col("value")).alias("corrupt"), F.explode_outer("m").alias("scene", "metrics"))
    return rows.select("side", "file", "modified", "corrupt", "scene", F.explode_outer("metrics").alias("name", "value")).where("scene is null or scene <> 'mean'")


def keep(store: str):
    """What a batch does: it replaces the folder of its number."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch}")

    return write


def follow(updates: DataFrame, store: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs over what is there now and ends, or (every: such as "30 seconds") goes on."""
    writer = updates.writeStream.foreachBatch(keep(store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """side, scene, name, value: each scene's rows of the last batch and file that named it."""
    rows = spark.read.schema(ROWS + ", batch long").parquet(store).where("scene is not null")
    newest = F.max(F.struct("batch", "modified", "file")).over(Window.partitionBy("side", "scene"))
    return rows.withColumn("newest", newest).where(F.struct("batch", "modified", "file") == F.col("newest")).select("side", "scene", "name", "value")


def failures(spark: SparkSession, store: str) -> DataFrame:
    """side, file, corrupt of the files that can't be read, as they were last."""
    rows = spark.read.schema(ROWS + ", batch long").parquet(store)
    newest = F.max(F.struct("batch", "modified")).over(Window.partitionBy("file"))
    return rows.withColumn("newest", newest).where((F.struct("batch", "modified") == F.col("newest")) & F.col("corrupt").isNotNull()).select("side", "file", "corrupt").distinct()


def board(spark: SparkSession, store: str, name: str) -> DataFrame:
    """scene, before, after, delta, status of one metric, from what the store holds now."""
    rows = latest(spark, store).where(F.col("name") == name)
    side = lambda s: rows.where(F.col("side") == s).select("scene", "value")
    return dashboard(side("before"), side("after"), "scene")

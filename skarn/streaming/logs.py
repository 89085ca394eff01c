"""Append-only logs as streams: last write wins, totals per window, stalled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.identity import latest


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of JSON-line files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def windowed_totals(stream: DataFrame, at: str, key: str, value: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, key, n, total; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def stalls(stream: DataFrame, at: str, key: str, gap: str = "600 seconds", late: str = "1 hour") -> DataFrame:
    """key, started, ended, n of the runs of a key: a run ends after a gap without a row."""
    runs = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return runs.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def upsert_latest(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str, compact: int = 64):
    """Keeps the last row per key of a stream in the folder target; a batch that is run again changes nothing.

    Each batch writes the last rows of its own keys to a folder of its own, so it costs what the batch costs; reading takes
    the last of all. Every so many batches what was written since the last base becomes a new base. Folders that a base
    replaces are removed when the next base is there, so that whoever reads one keeps it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, last = batch.sparkSession, [F.col(o) for o in order]
        latest(batch, key, last).write.mode("overwrite").parquet(f"{target}/v={number}")
        if (number + 1) % compact == 0:
            bases = [n for n in _finished(spark, target, "base") if n < number]
            _merged(spark, target, key, order, upto=number).write.mode("overwrite").parquet(f"{target}/base={number}")
            if bases:
                _remove(spark, target, max(bases))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def read_latest(spark: SparkSession, target: str, key: list[str], order: list[str]) -> DataFrame:
    """The table that upsert_latest keeps: of the newest base and all batches after it the last row per key."""
    return _merged(spark, target, key, order)


def _merged(spark: SparkSession, target: str, key: list[str], order: list[str], upto: int | None = None) -> DataFrame:
    wanted = lambda n: upto is None or n <= upto
    base = max((n for n in _finished(spark, target, "base") if wanted(n) and n != upto), default=-1)
    paths = [f"{target}/v={n}" for n in _finished(spark, target, "v") if n > base and wanted(n)] + ([f"{target}/base={base}"] if base >= 0 else [])
    return latest(spark.read.parquet(*paths), key, [F.col(o) for o in order])


def _folder(spark: SparkSession, target: str):
    """(file system, path) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbered(spark: SparkSession, target: str, kind: str) -> dict:
    fs, path = _folder(spark, target)
    found = [status.getPath() for status in fs.listStatus(path)] if fs.exists(path) else []
    return {int(p.getName().split("=")[1]): p for p in found if p.getName().startswith(f"{kind}=")}


def _finished(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind (v or base): those that hold a success mark."""
    fs, _ = _folder(spark, target)
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n, p in _numbered(spark, target, kind).items() if fs.exists(mark(p, "_SUCCESS")))


def _remove(spark: SparkSession, target: str, upto: int) -> None:
    """Removes what the base of this number replaced: batches up to it, and older bases."""
    fs, _ = _folder(spark, target)
    for kind, least in (("v", upto + 1), ("base", upto)):
        for n, path in _numbered(spark, target, kind).items():
            if n < least:
                fs.delete(path, True)

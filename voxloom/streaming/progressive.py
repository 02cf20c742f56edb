"""Streams: progressive unique results, windowed counts, resumable sessions, timelines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.joins import as_of, interpolated


def unique_stream(spark: SparkSession, path: str, schema: T.StructType | str, key: str, keep: str = "true", files: int = 1) -> DataFrame:
    """New rows of a folder of files, each key once over the whole stream; files a trigger bounds what one update holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).where(keep).dropDuplicates([key])


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Gives each batch of what is there now to each(); what a checkpoint has seen is not given again."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: Sequence[str]) -> DataFrame:
    """Rows and sums per window and key, closed once the watermark has passed; batch tables work alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def timeline(spark: SparkSession, keys: DataFrame, start: float, end: float, step: float, by: Sequence[str], easing: str = "linear") -> DataFrame:
    """by, frame, time, value: key frames (by, time, value) sampled at fixed steps."""
    frames = int(round((end - start) / step)) + 1
    probes = keys.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame")).withColumn("time", F.lit(start) + F.col("frame") * step)
    found = as_of(probes, keys, by, "time", "value")
    return found.select(*by, "frame", "time", interpolated(found, "time", easing).alias("value"))


class Session:
    """A resumable job over blocks: append-only commits in a shared folder, of which the newest that can be read wins.

    A commit is a folder of tables that is complete once its manifest is there, written last. The manifest of the session is checked on
    resume. The scheduler visits every block once: the unvisited block with most pending tasks, then the lowest index.
    """

    def __init__(self, spark: SparkSession, path: str, identity: dict):
        self.spark, self.path, self.identity = spark, path.rstrip("/"), json.loads(json.dumps(identity, sort_keys=True))
        found = self._read(f"{self.path}/session")
        if found is None:
            self._write(f"{self.path}/session", self.identity)
        elif found != self.identity:
            raise ValueError("another session lives in this folder")

    def _write(self, path: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _read(self, path: str) -> dict | None:
        try:
            rows = self.spark.read.text(path).collect()
            return json.loads(rows[0].value) if len(rows) == 1 else None
        except ValueError:  # broken: not loadable
            return None
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commits(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def commit(self, tables: dict[str, DataFrame], state: dict) -> int:
        """Writes the tables under new names and then the manifest that makes the commit count."""
        number = max(self._commits(), default=0) + 1
        names = {}
        for name, table in tables.items():
            names[name] = f"{self.path}/tables/{name}-{number}-{uuid.uuid4().hex}"
            table.write.parquet(names[name])
        self._write(f"{self.path}/commits/{number}", {"tables": names, "state": state})
        return number

    def load(self) -> tuple[int, dict[str, DataFrame], dict]:
        """(0, no tables, empty state) before the first commit; otherwise the newest loadable one."""
        for number in self._commits():
            found = self._read(f"{self.path}/commits/{number}")
            if found is None:
                continue
            try:
                return number, {name: self.spark.read.parquet(path) for name, path in found["tables"].items()}, found["state"]
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # a table is missing: an older commit counts
                    raise
        return 0, {}, {}


def next_block(blocks: DataFrame, pending: DataFrame) -> DataFrame:
    """The block to visit: unvisited, most pending tasks, lowest index. blocks: block, visited; pending: block."""
    counts = pending.groupBy("block").agg(F.count("*").alias("pending"))
    return blocks.where("NOT visited").join(counts, "block", "left").select("block", F.coalesce("pending", F.lit(0).cast("bigint")).alias("pending")).orderBy(F.desc("pending"), "block").limit(1)

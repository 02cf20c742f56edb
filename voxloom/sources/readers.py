"""Format detection: readers by extension, tried in turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession

from voxloom.sources import text

Reader = Callable[[SparkSession, str], DataFrame]
#: What a reader raises for content that it can't read; a store that can't be reached is an error of its own.
UNREADABLE = (AnalysisException, ArithmeticException, NumberFormatException, SparkRuntimeException, ValueError)
READERS: list[tuple[str, tuple[str, ...], Reader]] = [
    ("parquet", ("parquet", ""), lambda spark, path: spark.read.parquet(path)),
    ("swc", ("swc", "txt"), text.read_swc),
    ("apo", ("apo",), lambda spark, path: text.read_points(spark, path, "apo")),
    ("marker", ("marker",), lambda spark, path: text.read_points(spark, path, "marker")),
    ("xyz", ("xyz", "txt"), lambda spark, path: text.read_points(spark, path, "xyz")),
    ("table", ("csv", "tsv"), text.read_table),
    ("orc", ("orc",), lambda spark, path: spark.read.orc(path)),
]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reads with the first reader that claims the extension and finds rows; if none does, the errors of all."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[1].lower() if "." in name else ""
    errors = []
    for kind, extensions, reader in READERS:
        if extension in extensions:
            try:
                rows = reader(spark, path)
                if not rows.isEmpty():
                    return rows
                errors.append(f"{kind}: no rows")
            except UNREADABLE as error:
                if getattr(error, "getCondition", str)() == "PATH_NOT_FOUND":
                    raise
                errors.append(f"{kind}: {str(error).splitlines()[0]}")
    raise ValueError(f"no reader for {path}: {'; '.join(errors) or 'unknown extension'}")


def infos(voxels: DataFrame) -> DataFrame:
    """Size and value range of every image, without its voxels' order."""
    from pyspark.sql import functions as F

    return voxels.groupBy("image_id").agg(*((F.max(a) + 1).alias(n) for a, n in (("x", "width"), ("y", "height"), ("z", "depth"), ("c", "num_channels"), ("t", "num_times"))), F.min("v").alias("min_v"), F.max("v").alias("max_v"))

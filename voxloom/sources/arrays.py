"""NumPy arrays in and out: a local array becomes bricks, tasks see bricks as arrays, a bounded image comes back as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxels that may come back to the driver as one array.
MOST = 1 << 28
PLACE = ("cz", "cy", "cx", "z0", "y0", "x0", "d", "h", "w")


def from_array(spark: SparkSession, image: np.ndarray, chunk: Mapping[str, int], image_id: int = 0) -> DataFrame:
    """Bricks (as of chunks.to_chunks) of an array of axes t, c, z, y, x; missing axes at the front have one place. Values become longs or doubles."""
    image = image.reshape((1,) * (5 - image.ndim) + image.shape)
    kind = np.float64 if image.dtype.kind == "f" else np.int64
    rows: dict[str, list] = {k: [] for k in ("image_id", "t", "c", *PLACE, "data")}
    step = [chunk[a] for a in "zyx"]
    for t, c in np.ndindex(image.shape[:2]):
        for at in np.ndindex(*(-(-n // s) for n, s in zip(image.shape[2:], step, strict=True))):
            low = [a * s for a, s in zip(at, step, strict=True)]
            brick = image[t, c][tuple(slice(a, a + s) for a, s in zip(low, step, strict=True))]
            for k, v in zip(rows, (image_id, t, c, *at, *low, *brick.shape, brick.astype(kind).ravel()), strict=True):
                rows[k].append(v)
    numbers = {k: pa.array(v, pa.int64()) for k, v in rows.items() if k != "data"}
    table = pa.table(numbers | {"data": pa.array(rows["data"], pa.list_(pa.from_numpy_dtype(kind)))})
    return spark.createDataFrame(table).withColumns({"level": F.lit(0), "ratio": F.lit(1)})


def map_bricks(chunks: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """chunks with function applied to each brick's array (d, h, w), which must keep its shape; the values arrive without a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {k: batch.schema.get_field_index(k) for k in ("data", "d", "h", "w")}
            shapes = zip(*(batch.column(at[k]).to_pylist() for k in "dhw"), strict=True)
            out = []
            for data, shape in zip(batch.column(at["data"]), shapes, strict=True):
                brick = function(data.values.to_numpy(zero_copy_only=False).reshape(shape))
                if brick.shape != shape:
                    raise ValueError(f"a brick of {shape} became one of {brick.shape}")
                out.append(brick.ravel())
            columns = [pa.array(out, batch.schema.field(i).type) if i == at["data"] else column for i, column in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return chunks.mapInArrow(run, chunks.schema)


def to_array(chunks: DataFrame, size: Mapping[str, int], dtype: str, fill: float = 0) -> np.ndarray:
    """One image's bricks as an array of axes t, c, z, y, x; fill where no brick is. Images of more than MOST voxels are refused."""
    if int(np.prod([size[a] for a in "tczyx"])) > MOST:
        raise ValueError("the image is too large for one array; crop it or use map_bricks()")
    out = np.full([size[a] for a in "tczyx"], fill, dtype=dtype)
    for batch in chunks.select("t", "c", *PLACE[3:], "data").toArrow().to_batches():
        for t, c, z, y, x, d, h, w, data in zip(*(column.to_pylist() for column in batch.columns[:-1]), batch.column(batch.num_columns - 1), strict=True):
            out[t, c, z : z + d, y : y + h, x : x + w] = data.values.to_numpy(zero_copy_only=False).reshape(d, h, w)
    return out

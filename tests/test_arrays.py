"""Arrays in and out of bricks."""

import numpy as np
import pytest

from voxloom.sources import arrays, chunks


@pytest.mark.parametrize("dtype", ["uint16", "float32"])
def test_round_trip(spark, dtype):
    rng = np.random.default_rng(1)
    image = (rng.random((2, 1, 5, 7, 6)) * 1000).astype(dtype)
    size = dict(zip("tczyx", image.shape, strict=True))
    bricks = arrays.from_array(spark, image, {"z": 2, "y": 3, "x": 4}, 9)
    assert bricks.count() == 2 * 3 * 3 * 2 and (arrays.to_array(bricks, size, dtype) == image).all()
    got = {(r.t, r.c, r.z, r.y, r.x): r.v for r in chunks.to_voxels(bricks).collect()}
    assert got == {at: v.item() for at, v in np.ndenumerate(image)}
    doubled = arrays.map_bricks(bricks, lambda b: b * 2 + b.shape[2])
    assert sorted(doubled.columns) == sorted(bricks.columns)
    want = image.astype("float64") * 2 + np.array([4, 4, 4, 4, 2, 2])
    assert (arrays.to_array(doubled, size, "float64") == want).all()
    part = arrays.to_array(bricks.where("cx = 0"), size, dtype, fill=3)
    assert (part[..., :4] == image[..., :4]).all() and (part[..., 4:] == 3).all()
    plane = arrays.from_array(spark, image[0, 0, 0], {"z": 1, "y": 3, "x": 4})
    assert (arrays.to_array(plane, size | {"t": 1, "z": 1}, dtype)[0, 0, 0] == image[0, 0, 0]).all()


def test_wrong_shapes_and_sizes(spark):
    bricks = arrays.from_array(spark, np.zeros((3, 3), dtype="uint8"), {"z": 1, "y": 2, "x": 2})
    with pytest.raises(Exception, match="became one of"):
        arrays.map_bricks(bricks, lambda b: b[:, :, :1]).collect()
    with pytest.raises(ValueError, match="too large"):
        arrays.to_array(bricks, {"t": 1, "c": 1, "z": 4096, "y": 4096, "x": 4096}, "uint8")

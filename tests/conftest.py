import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from rastertables.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", 8, 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rasters():
    """Two volumes of two random planes, 11 x 13."""
    rng = np.random.default_rng(5)
    return {(v, z): rng.random((11, 13)) for v in ("a", "b") for z in (0, 1)}


def to_rows(spark, planes, value=True):
    out = []
    for (v, z), a in planes.items():
        yy, xx = np.nonzero(np.ones_like(a)) if value else np.nonzero(a)
        d = pd.DataFrame({"volume_id": v, "z": z, "y": yy.astype("int32"), "x": xx.astype("int32")})
        if value:
            d["value"] = a.ravel().astype(float)
        out.append(d)
    d = pd.concat(out).astype({"z": "int32"})
    schema = "volume_id string, z int, y int, x int" + (", value double" if value else "")
    return spark.createDataFrame(d, schema)


def extents(spark, planes):
    return spark.createDataFrame([(v, z, *a.shape) for (v, z), a in planes.items()], "volume_id string, z int, height int, width int")


def to_planes(df, shapes, value="value", fill=0.0):
    out = {k: np.full(s, fill) for k, s in shapes.items()}
    for r in df.toPandas().itertuples(index=False):
        out[(r.volume_id, r.z)][r.y, r.x] = getattr(r, value) if value else 1
    return out

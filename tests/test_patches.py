"""Patch statistics against plain NumPy, and how often they read their image."""
import numpy as np
import pytest
from conftest import to_rows

from rastertables import session
from rastertables.operators import grid as G


def statistics(a, patch):
    """f0..f7 and f13 of every patch before they are standardised."""
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[:, :-1], gy[:-1] = np.diff(a, axis=1), np.diff(a, axis=0)
    g = np.sqrt(gx ** 2 + gy ** 2)
    out = {}
    for i in range(0, a.shape[0], patch):
        for j in range(0, a.shape[1], patch):
            v, s = a[i:i + patch, j:j + patch], g[i:i + patch, j:j + patch]
            out[i // patch, j // patch] = [v.mean(), v.std(), v.max(), v.min(), s.mean(), s.std(), s.max(), s.min(), (v > a.mean()).mean()]
    return out


def standardised(cells):
    m = np.array(list(cells.values()))
    return dict(zip(cells, (m - m.mean(axis=0)) / (m.std(axis=0, ddof=1) + 1e-6)))


@pytest.mark.parametrize("tile", [256, 8])
def test_patch_statistics_match_numpy(spark, rasters, monkeypatch, tile):
    """Patches that the image cuts off, and gradients that look into the next tile."""
    whole = G.tiles.patches
    monkeypatch.setattr(G.tiles, "patches", lambda *a, **k: whole(*a, **k, tile=tile))
    got = {(r.volume_id, r.z, r.gy, r.gx): r for r in G.patch_statistics(to_rows(spark, rasters), 4).collect()}
    assert len(got) == 4 * 12
    for (v, z), a in rasters.items():
        for (gy, gx), f in standardised(statistics(a, 4)).items():
            assert [got[v, z, gy, gx][f"f{i}"] for i in (*range(8), 13)] == pytest.approx(list(f), abs=1e-6)


def test_patches_of_null_and_missing_cells(spark):
    rows = [("a", 0, y, x, None if (y, x) == (0, 0) else float(x)) for y in range(4) for x in range(8) if (y, x) != (1, 1)]
    df = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, value double")
    cells = {r.gx: r for r in G.tiles.patches(df, lambda p, s, t: [G._statistics(p["value"], t, (True, True), 4)], (1, 1), (None, None), 4, ["value"], G._PATCH_FIELDS[:-1]).collect()}
    assert cells[0]["_n"] == 14 and cells[0]["_sum"] == 23.0 and sorted(cells[0]["_values"]) == sorted(r[4] for r in rows if r[3] < 4 and r[4] is not None)
    assert cells[1].f0 == pytest.approx(5.5) and cells[1].f2 == 7.0


def test_interleaved_vectors_read_their_image_once(spark, rasters):
    """One read of the image for all shifted copies; each copy is what patch_vectors makes of the shifted image."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = to_rows(spark, rasters)
    got = {(r.volume_id, r.z, r.gy, r.gx): r.vec for r in G.interleaved_vectors(df.mapInArrow(count, df.schema), 2, 4, 11, 13).collect()}
    assert read.value == 4 * 11 * 13
    for a, dy in enumerate((-1.0, 1.0)):
        for b, dx in enumerate((-1.0, 1.0)):
            one = G.patch_vectors(session.materialize(G.shift_plane(df, dy, dx, 11, 13)), 4).collect()
            for r in one:
                assert got[r.volume_id, r.z, r.gy * 2 + a, r.gx * 2 + b] == pytest.approx(r.vec, abs=1e-9)
    assert len(got) == 4 * 4 * 12 and all(len(v) == 64 for v in got.values())

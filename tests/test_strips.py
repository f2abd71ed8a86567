"""Distances in many small strips, which once were a Python group each."""
import numpy as np
import pyarrow as pa

from rastertables.operators import distance


def test_strips_of_one_height_are_solved_side_by_side():
    f = np.random.default_rng(3).integers(0, 40, (5, 9, 4)).astype(float)
    f[f > 25] = np.inf
    f[2] = np.inf
    got = distance.short_column_distances(f, 1.5)
    step = 2.25 * (np.arange(9)[:, None] - np.arange(9)) ** 2
    assert np.array_equal(got, (f[:, None, :, :] + step[None, :, :, None]).min(axis=2))


def test_batches_are_cut_between_groups():
    keys = ["a"] * 3 + [None] * 4 + ["b"] * 6 + ["c"]
    rows = pa.table({"k": pa.array(keys), "n": pa.array([0] * 9 + [1] * 5), "at": pa.array(range(14))})
    for size in (1, 2, 3, 5, 14):
        seen, groups = [], []
        for table, group in distance._whole_groups(rows.to_batches(max_chunksize=size), ["k", "n"]):
            seen += table.column("at").to_pylist()
            groups += [table.column("at").filter(pa.array(group == g)).to_pylist() for g in range(group[-1] + 1)]
        assert seen == list(range(14))
        assert groups == [[0, 1, 2], [3, 4, 5, 6], [7, 8], [9, 10, 11, 12], [13]]


def test_objects_of_several_heights_have_distances_of_their_own(spark):
    boxes = {n: (1 + n % 4, 2 + n % 3, 70 * (n % 2)) for n in range(40)}
    rows = spark.createDataFrame([(n, y, x, x + w) for n, (h, w, x) in boxes.items() for y in range(h)], "comp long, y int, x0 int, x1 int")
    target = spark.createDataFrame([(n, h, x, x + w) for n, (h, w, x) in boxes.items()], "comp long, y int, x0 int, x1 int")
    ext = spark.createDataFrame([(n, h + 1, 90) for n, (h, _, _) in boxes.items()], "comp long, height int, width int")
    d = distance.distance_to_mask(rows, target, ext, keys=["comp"])
    assert "FlatMapGroupsInArrow" not in d._jdf.queryExecution().toString()
    got = {(r.comp, r.y, r.x): r.dist for r in d.collect()}
    assert got == {(n, y, x + i): float(h - y) for n, (h, w, x) in boxes.items() for y in range(h) for i in range(w)}

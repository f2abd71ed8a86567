"""Sharding by sampled splitters: a sample drawn by size gives the quantiles of the key, records fall into the ranges
between them, and ranges that turn out overfull are sampled again and split. Ranges are then short enough to be numbered
one per task, and exact running totals over them cut the order into shards of nearly equal bytes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import uniform
from .common import materialize

RANGES_PER_SHARD, SAMPLES_PER_RANGE, ROUNDS = 8, 24, 12
LOW = -(1 << 63)


def _ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows (k1, k2, ...) with the number of splitters at or below the key (k1, k2)."""
    first, second = np.array([a for a, _ in splitters], np.int64), np.array([b for _, b in splitters], np.int64)
    names = [*rows.columns, "_range"]

    def run(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            lo, hi = np.searchsorted(first, k1, "left"), np.searchsorted(first, k1, "right")
            tied = np.nonzero(hi > lo)[0]
            for k in np.unique(k1[tied]):   # Splitters inside one first key, as a group of copies has
                at = tied[k1[tied] == k]
                a, z = lo[at[0]], hi[at[0]]
                lo[at] = a + np.searchsorted(second[a:z], k2[at], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lo.astype(np.int32))], names=names)

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", _range int") if splitters else rows.withColumn("_range", F.lit(0))


def splitters(rows: DataFrame, ranges: int) -> tuple[list[tuple[int, int]], DataFrame]:
    """Splitters of rows (k1, k2, size, ...), and the ranges' bytes and rows. Overfull ranges (over twice their fair share,
    with more than one key) are sampled again until there are none. The driver holds the sample: some SAMPLES_PER_RANGE keys
    a range, whatever the table's size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    found: list[tuple[int, int]] = []
    if total == 0:
        return found, _ranges(rows, found)
    fair = total / ranges
    dealt = _ranges(rows, found)
    open_ranges = {0: total}
    for turn in range(ROUNDS):
        want = {r: SAMPLES_PER_RANGE * max(2, round(n / fair)) / n for r, n in open_ranges.items()}
        rate = F.element_at(F.create_map(*[x for r, p in want.items() for x in (F.lit(r), F.lit(p))]), F.col("_range")) if want else F.lit(0.0)
        drawn = dealt.where(F.col("_range").isin(list(want)) & (uniform("k1", "k2", F.lit(turn)) < F.coalesce(F.col("size") * rate, F.lit(0.0)))).select("_range", "k1", "k2").distinct().collect()
        for r, n in open_ranges.items():
            keys = sorted((x.k1, x.k2) for x in drawn if x._range == r)
            pieces = max(2, round(n / fair))
            found += [keys[len(keys) * i // pieces] for i in range(1, pieces) if len(keys) * i // pieces < len(keys)]
        found = sorted(set(found))
        dealt = _ranges(rows, found)
        full = dealt.groupBy("_range").agg(F.sum("size").alias("n"), F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("z")).where((F.col("n") > 2 * fair) & (F.col("a") != F.col("z"))).collect()
        open_ranges = {x._range: x.n for x in full}
        if not open_ranges:
            break
    return found, dealt


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 16), text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    The order is that of the text's hash, then the key: equal texts are neighbours, and a group of copies larger than a
    shard is cut by key. Shards differ by a record's size at most. Null texts are empty; null keys come first; rows equal in
    key and text are neighbours in one range. Only keys and sizes are shuffled, never texts."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.xxhash64(t).alias("k1"), F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("k2"), (F.octet_length(t) + 16).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"), F.col(key).cast("long").alias("_key")))
    _, dealt = splitters(rows, shards * RANGES_PER_SHARD)
    sums = dealt.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("_range").collect()
    total = sum(r.bytes for r in sums)
    if total == 0:
        return rows.select(F.col("_key").alias(key), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    offsets, bytes_before, rows_before = [], 0, 0
    for r in sums:   # One entry per range: shards * RANGES_PER_SHARD and what overfull ranges added
        offsets.append((r._range, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r.bytes, rows_before + r.n
    starts = rows.sparkSession.createDataFrame(offsets, "_range int, _bytes long, _rows long")
    inside = Window.partitionBy("_range").orderBy("k1", "k2", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (dealt.withColumn("_upto", F.sum("size").over(inside)).withColumn("_no", F.count("*").over(inside))
                .join(F.broadcast(starts), "_range")
                .withColumn("_before", F.col("_bytes") + F.col("_upto") - F.col("size")).withColumn("_index", F.col("_rows") + F.col("_no") - 1)
                .withColumn("shard", F.expr(f"least({shards - 1}, cast((cast(2 * _before + size as decimal(38,0)) * {shards}) div {2 * total} as int))")))
    numbered = materialize(numbered.select("_key", "size", "text_crc32", "shard", "_index"))
    first = numbered.groupBy("shard").agg(F.min("_index").alias("_first"))   # As many rows as shards
    return numbered.join(F.broadcast(first), "shard").select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write docs in shard folders in slot order; plan is what shard() returned for the same rows with unique keys."""
    rows = docs.join(plan.select(key, "shard", "slot"), key)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

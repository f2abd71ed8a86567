"""Ranked lexical search by pipelined term partitioning.

Documents lie in blocks, and every term has an owner: stage 0 owns the rare terms, later stages commoner ones. A bundle of
items travels through the owners with a sparse accumulator of document scores per block; each owner adds the integer
contributions of its postings and hands the bundle on. After the last owner every block names its best documents, and the
best of all blocks are ranked."""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOP = 20
#: Documents of a block, postings after which a block is closed early, items of a bundle (about).
BLOCK, BLOCK_POSTINGS, BUNDLE = 2048, 1 << 20, 128
#: A term belongs to the first stage whose divisor d has df * d <= N, or else to the last stage.
OWNERS = (64, 8)
#: Terms asked for are looked for while scanning if they are no more than this; otherwise all are indexed and joined.
ASKED_TERMS, ASKED_BYTES = 200_000, 8 << 20
#: No contribution exceeds the weight times this.
MOST = 1_000_000
NO_TERM = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: On UTF-8 bytes: those of no term become spaces, A-Z lower case; bytes above 127 are parts of longer characters.
_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

INDEX = "block long, term string, docs binary, tfs binary, ids array<long>, ns binary"
CARRIED = "bundle int, block long, item {item}, docs binary, scores binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return text.translate(_BYTES).split()


def _closed(block: int, postings: dict, ids: list, ns: list):
    """A block as batches: its directory (ids and term counts of its documents) and the postings of each term."""
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("docs", pa.binary()), ("tfs", pa.binary()), ("ids", pa.list_(pa.int64())), ("ns", pa.binary())])
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[block], [None], [None], [None], [ids], [np.array(ns, np.int64).tobytes()]], schema)], schema=schema)
    names = list(postings)
    for at in range(0, len(names), 10_000):
        part = names[at:at + 10_000]
        docs = [np.array(postings[t][0], np.uint16).tobytes() for t in part]
        tfs = [np.array(postings[t][1], np.int32).tobytes() for t in part]
        none = pa.nulls(len(part))
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(docs), pa.array(tfs), none.cast(pa.list_(pa.int64())), none.cast(pa.binary())], schema=schema)


def build_index(docs: DataFrame, wanted: frozenset | None = None, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Postings by block: for each term of a block the places of its documents in the block and the term's counts, and one
    row without a term, the block's directory. Written once; wanted (UTF-8 terms) leaves other terms out."""
    seen = wanted and docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        number, postings, ids, ns, held = TaskContext.get().partitionId() << 32, {}, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                found = terms(t.as_py())
                counts = Counter(found)
                for term in counts.keys() & seen.value if seen else counts:
                    at = postings.setdefault(term, ([], []))
                    at[0].append(len(ids))
                    at[1].append(counts[term])
                    held += 1
                ids.append(i)
                ns.append(len(found))
                if len(ids) == block or held >= BLOCK_POSTINGS:
                    yield from _closed(number, postings, ids, ns)
                    number, postings, ids, ns, held = number + 1, {}, [], [], 0
        if ids:
            yield from _closed(number, postings, ids, ns)

    return materialize(docs.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, INDEX), compression="zstd")


def _owned(big_n: int, big_l: int, top: int, last: bool, item_type: pa.DataType):
    """What an owner does with a bundle's accumulators in one block."""
    def run(key, carried: pa.Table, owned: pa.Table) -> pa.Table:
        held, rest, ids, m, routes = {}, {}, None, None, []
        for r in owned.to_pylist():
            if r["ids"] is None:
                routes.append(r)
            else:
                ids, m = r["ids"], 100 - 25 + 25 * np.frombuffer(r["ns"], np.int64) * big_n // big_l
        for r in carried.to_pylist():
            held[r["item"]] = a = np.zeros(len(ids), np.int64)
            a[np.frombuffer(r["docs"], np.uint16)] = np.frombuffer(r["scores"], np.int64)
        for r in routes:
            at, tf = np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["tfs"], np.int32).astype(np.int64)
            gain = r["w"] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
            for ask in r["asks"]:
                if ask["item"] not in held:
                    held[ask["item"]] = np.zeros(len(ids), np.int64)
                held[ask["item"]][at] += ask["times"] * gain
                rest[ask["item"]] = ask["rest"]
        out = []
        if last:
            known = np.array([i is not None for i in ids], bool) if ids else None
            number = np.array([i or 0 for i in ids], np.int64) if ids else None
            for item, a in held.items():
                on = np.nonzero((a > 0) & known)[0]
                best = on[np.lexsort((number[on], -a[on]))[:top]]
                out += [(item, number[k], a[k]) for k in best]
            return pa.table({"item": pa.array([x[0] for x in out], item_type), "doc": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})
        known = np.array([i is not None for i in ids], bool) if ids else None
        for item, a in held.items():
            on = a > 0
            if item in rest and known.sum() > top:
                # Lossless: the block alone holds `top` documents that this one cannot reach with all later terms
                on &= a + rest[item] >= np.partition(a[known], -top)[-top]
            at = np.nonzero(on)[0]
            if len(at):
                out.append((item, at.astype(np.uint16).tobytes(), a[at].tobytes()))
        n = len(out)
        return pa.table({"bundle": pa.array([key[0].as_py()] * n, pa.int32()), "block": pa.array([key[1].as_py()] * n, pa.int64()), "item": pa.array([x[0] for x in out], item_type),
                         "docs": pa.array([x[1] for x in out], pa.binary()), "scores": pa.array([x[2] for x in out], pa.binary())})

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text",
           block: int = BLOCK, bundle: int = BUNDLE, owners: tuple = OWNERS, asked_terms: int = ASKED_TERMS) -> DataFrame:
    """item, rank (int, from 1), key, score: each item's `top` documents with the highest scores above 0, equal ones by key.

    Null and empty texts hold no term. Rows without a key count as documents but are never returned; rows that share a key
    are documents of their own. Items that share an id are one item with the texts of all; items without an id are not
    asked. A document of any length is one posting per term; a common term is dealt by blocks."""
    spark = docs.sparkSession
    words = F.explode(F.split(F.translate(F.coalesce(F.col(item_text), F.lit("")), UPPER, UPPER.lower()), NO_TERM)).alias("term")
    asks = materialize(items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words).where("term <> ''").groupBy("item", "term").agg(F.count("*").alias("times")))
    item_type = asks.schema["item"].dataType.simpleString()
    vocabulary = asks.select("term").distinct()
    size = vocabulary.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    few = size["n"] <= asked_terms and (size["bytes"] or 0) <= ASKED_BYTES
    index = build_index(docs, frozenset(r["term"].encode() for r in vocabulary.collect()) if few else None, key, text, block)
    directory = index.where("term IS NULL").select("block", "ids", "ns")
    if not few:
        index = index.join(vocabulary, "term", "left_semi")
    postings = index.where("term IS NOT NULL").select("block", "term", "docs", "tfs")

    def counted(batches):
        for b in batches:
            ns = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in ns], pa.int64()), pa.array([int(x.sum()) for x in ns], pa.int64())], names=["n", "l"])

    total = directory.select("ns").mapInArrow(counted, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    big_n, big_l = total["n"] or 0, total["l"] or 0
    n_items = asks.agg(F.countDistinct("item")).first()[0]
    bundles = max(1, -(-n_items // bundle))
    df = postings.groupBy("term").agg((F.sum(F.octet_length("docs")) / 2).cast("long").alias("df"))
    owner = F.lit(len(owners))
    for s, d in reversed(list(enumerate(owners))):
        owner = F.when(F.col("df") * d <= big_n, s).otherwise(owner)
    weighed = asks.join(df, "term").select("item", "term", "times", owner.alias("owner"), F.floor(1000 * F.log(F.lit(float(2 * big_n + 2)) / (2 * F.col("df") + 1))).alias("w"))
    later = weighed.groupBy("item").agg(*[F.sum(F.when(F.col("owner") > s, F.col("times") * F.col("w") * MOST).otherwise(0)).alias(f"r{s}") for s in range(len(owners) + 1)])
    rest = F.array(*[F.col(f"r{s}") for s in range(len(owners) + 1)])
    routes = materialize(weighed.join(later, "item").withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
                         .groupBy("bundle", "term", "owner", "w").agg(F.collect_list(F.struct("item", "times", F.get(rest, F.col("owner")).alias("rest"))).alias("asks")))
    listing = directory.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "block", F.lit(None).cast("long").alias("w"),
                               F.lit(None).cast(routes.schema["asks"].dataType).alias("asks"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("tfs"), "ids", "ns")
    carried = spark.createDataFrame([], CARRIED.format(item=item_type))
    for s in range(len(owners) + 1):
        owned = postings.join(routes.where(F.col("owner") == s), "term").select("bundle", "block", "w", "asks", "docs", "tfs", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("ns"))
        last = s == len(owners)
        run = _owned(big_n, big_l, top, last, _arrow(item_type))
        met = carried.groupBy("bundle", "block").cogroup(owned.unionAll(listing).groupBy("bundle", "block"))
        carried = met.applyInArrow(run, f"item {item_type}, doc long, score long" if last else CARRIED.format(item=item_type))
        if not last:
            carried = materialize(carried, compression="zstd")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return carried.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

"""Benchmark decontamination by spaced seeds.

A window of SPAN words is hashed once per mask; a mask ignores the positions it does not list. The three masks split the
window's positions between them, so two substituted words can spoil two masks at most and the third still hits: every
window of a document that equals a window of a benchmark item in at least SPAN - 2 positions is found. Each hit is then
verified position by position. Items too short for a window are looked for as a whole, without substitutions. Words are
compared in lower case, as 64-bit hashes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spark_words

SPAN = 13
MASKS = ((0, 3, 6, 9, 12), (1, 4, 7, 10), (2, 5, 8, 11))
SUBSTITUTIONS = 2
#: Items of fewer words than SPAN, but this many at least, are found as a whole.
SHORTEST = 5
#: Benchmark rows of some 200 bytes each that are broadcast at most (50 MB).
SEED_ROWS = 250_000


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the word hashes h of every text."""
    words = spark_words(F.lower(F.col(text)))
    return df.select(F.col(key), F.transform(words, lambda x: F.xxhash64(x)).alias("h"))


def _seeds(d: DataFrame, span: int, masks) -> DataFrame:
    """A row per window and mask: at (first word), mask, seed; h stays along."""
    h = F.col("h")
    per_window = lambda i: F.array(*[F.xxhash64(F.lit(m), *[F.get(h, i + k) for k in mask]) for m, mask in enumerate(masks)])
    n = len(masks)
    seeds = F.when(F.size(h) >= span, F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - span), per_window)))
    # The outer form, as the other one makes Spark repeat the whole expression in a filter below it
    exploded = d.withColumn("_seeds", seeds).select(*d.columns, F.posexplode_outer("_seeds").alias("_pos", "seed"))
    return exploded.withColumn("at", (F.col("_pos") / n).cast("int")).drop("_pos")


def _joined(rows: DataFrame, bench: DataFrame, on: list[str], span):
    """rows with h and at meet bench, and how to read word k of the row's window. Short benchmarks are broadcast; else both
    sides are shuffled, and rows carry their window only, not the whole text."""
    if bench.count() <= SEED_ROWS:
        return rows.join(F.broadcast(bench), on), lambda k: F.get("h", F.col("at") + k)
    return rows.withColumn("w", F.slice(F.col("h"), F.col("at") + 1, span)).drop("h").join(bench, on), lambda k: F.get("w", F.lit(k))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text", substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """Verified windows: key, item, doc_at, item_at, equal (positions alike, SPAN - substitutions at least), span (words of
    the window: SPAN, or the whole item of SHORTEST to SPAN - 1 words).

    Null and empty texts and items of fewer than SHORTEST words match nothing. `substitutions` up to 2 lose nothing. The
    seeds of the test set are counted first; only up to SEED_ROWS of them are broadcast, beyond that Spark shuffles windows
    of SPAN words on both sides, whatever the length of a text."""
    if not 0 <= substitutions < len(MASKS):
        raise ValueError(f"The masks tolerate 0 to {len(MASKS) - 1} substitutions")
    hashed = _hashed(items, item, item_text).withColumnRenamed(item, "_item")
    bench = _seeds(hashed, SPAN, MASKS).select("_item", F.col("at").alias("item_at"), F.slice(F.col("h"), F.col("at") + 1, SPAN).alias("item_h"), "seed").where("seed IS NOT NULL").distinct()
    texts = _hashed(docs, key, text)
    hits, word = _joined(_seeds(texts, SPAN, MASKS), bench, ["seed"], F.lit(SPAN))
    equal = sum((word(k) == F.get("item_h", F.lit(k))).cast("int") for k in range(SPAN))
    long = hits.select(key, F.col("_item").alias(item), F.col("at").alias("doc_at"), "item_at", equal.alias("equal"), F.lit(SPAN).alias("span")).where(F.col("equal") >= SPAN - substitutions)
    short = hashed.where(F.size("h").between(SHORTEST, SPAN - 1)).select("_item", F.col("h").alias("item_h"), F.size("h").alias("span"), F.xxhash64("h").alias("seed")).distinct()
    spans = sorted(r["span"] for r in short.select("span").distinct().collect())   # SPAN - SHORTEST numbers at most
    if not spans:
        return long
    windows = F.flatten(F.transform(F.array(*[F.lit(n) for n in spans]), lambda n: F.when(F.size("h") >= n, F.transform(
        F.sequence(F.lit(0), F.size("h") - n), lambda i: F.struct(n.alias("span"), i.alias("at"), F.xxhash64(F.slice("h", i + 1, n)).alias("seed")))).otherwise(
            F.array().cast("array<struct<span:int,at:int,seed:bigint>>"))))
    rows = texts.withColumn("_w", windows).select(key, "h", F.explode("_w").alias("_w")).select(key, "h", "_w.*")
    whole, word = _joined(rows, short, ["span", "seed"], F.col("span"))
    for k in range(SPAN - 1):
        whole = whole.where((F.col("span") <= k) | (word(k) == F.get("item_h", F.lit(k))))
    return long.unionAll(whole.select(key, F.col("_item").alias(item), F.col("at").alias("doc_at"), F.lit(0).alias("item_at"), F.col("span").alias("equal"), "span"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", **how) -> DataFrame:
    """One row per document and benchmark item that share a window: how many windows, the best of them, and where the
    overlap begins and ends in the document (in words)."""
    m = matches(docs, items, key, item, **how)
    return m.groupBy(key, item).agg(
        F.countDistinct("doc_at", "item_at").alias("n_windows"), F.max("equal").cast("long").alias("best_equal"),
        F.min("doc_at").cast("long").alias("first_word"), F.max(F.col("doc_at") + F.col("span") - 1).cast("long").alias("last_word"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the contaminated ones, all columns kept. Rows with a null key are never matched and stay."""
    bad = matches(docs, items, key, **how).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")

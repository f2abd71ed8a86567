"""Removal of lines that many documents share, by native operators only.

Hashes of the long lines are range-partitioned and sorted by document and position; one pass over a range streams the first
occurrence of a line in each document. What comes back is a keep bitmap per document, run by run, never text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialize

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    k = F.btrim(line, F.lit(WHITE))
    # All-ASCII lines take the quick way; lower() alone would also change other alphabets
    return F.when(F.octet_length(k) == F.char_length(k), F.lower(k)).otherwise(F.translate(k, UPPER, UPPER.lower()))


def _long_lines(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """doc, t (hash of the text), n_lines, pos, h1, h2 (hashes of the line's key) of every long line."""
    split = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(_text(text)).alias("t"), F.split(_text(text), "\n").alias("lines"))
    each = split.select("doc", "t", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    long = each.where(F.char_length(F.btrim("line", F.lit(WHITE))) >= min_chars)
    return long.select("doc", "t", "n_lines", "pos", F.xxhash64(line_key(F.col("line"))).alias("h1"), F.xxhash64(F.lit(1), line_key(F.col("line"))).alias("h2"),
                       F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, t (xxhash64 of the text, null as empty), n_lines, n_dropped and keep for each document that loses a line.

    keep lists the runs of kept lines as (start, n), start from 0: a run-length bitmap of the document's lines. A line is
    dropped if its key has min_chars characters and stands in min_docs documents, unless this is the largest of them.
    Null texts are one empty line. Rows without a key keep every line and count as no document; rows that share a key are
    one document, with a bitmap per text. A line that a third of all rows hold is spread over SALTS ranges."""
    rows = materialize(_long_lines(docs, key, text, min_chars))
    occurrence = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "pos")
    streamed = rows.repartitionByRange("h1", "salt").withColumn("_last", F.lag("doc").over(occurrence))
    firsts = streamed.where(F.col("_last").isNull() | (F.col("_last") != F.col("doc")))
    shared = (firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("owner"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("_salts"))
              .where(F.col("n_docs") >= min_docs).select("h1", "h2", "owner", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> shiftright(_salts, i) % 2 <> 0)")).alias("salt")))
    dropped = rows.join(shared, ["h1", "h2", "salt"]).where("doc <> owner")
    per_doc = dropped.groupBy("doc", "t").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("_gone"))
    gone = F.col("_gone")
    bounds = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.struct(
        (F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 1).alias("start"),
        (F.coalesce(F.get(gone, i), F.col("n_lines")) - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1).alias("n")))
    return per_doc.select(F.col("doc").alias(key), "t", "n_lines", F.size(gone).alias("n_dropped"), F.filter(bounds, lambda r: r["n"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (all columns and rows) with n_lines, n_dropped and kept_text, which replace columns of these names; documents
    without a bitmap keep their whole text."""
    b = bitmaps.select(F.col(key).alias("_key"), F.col("t").alias("_t"), F.col("n_dropped").alias("_dropped"), F.col("keep").alias("_keep"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]).alias("_doc"), F.col(key).alias("_id"), _text(text).alias("_text"))
    lines = F.split("_text", "\n")
    kept = F.array_join(F.flatten(F.transform("_keep", lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n")
    out = rows.join(b, (F.col("_id") == F.col("_key")) & (F.xxhash64("_text") == F.col("_t")), "left")
    return out.select("_doc.*", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.coalesce(kept, F.col("_text")).alias("kept_text"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256 of every row."""
    kept = apply_bitmaps(docs.select(key, text), materialize(keep_bitmaps(docs, key, text, **how)), key, text)
    return kept.select(key, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

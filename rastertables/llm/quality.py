"""Rule bitmask ledger: every rule is evaluated once per document, its failure is a bit and its measurement a column;
policies are sets of rule bits with a version, applied to the ledger without touching the texts again."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spark_words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words"]


@dataclass(frozen=True)
class Rule:
    """A document fails where the expression over the measurements is true; the bit never changes its meaning."""
    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """Rules that a version enforces. `base` rules reject whatever the version says."""
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule(4, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(5, "letterless_words", "10 * n_letter_words < 4 * n_words"),
)
BASE = ("few_words", "repeated_trigrams")
POLICIES = (Policy("v1", BASE), Policy("v2", BASE + ("symbols", "repeated_lines")), Policy("v3", tuple(r.name for r in RULES)))


def _packed_windows(w: Column, n: Column) -> tuple[Column, Column]:
    """The 3-word windows as longs, and the mask of their position bits (kept in the column _low).

    A window is one long: the top bits of its hash, its position below. One primitive sort brings equal windows
    together; neighbours with equal top bits are compared word by word, so a hash collision never counts as a repeat
    (a window could only be missed if another, different window with the same top bits sorted between two equal ones)."""
    windows = F.sequence(F.lit(0), n - 3)
    low = F.pow(F.lit(2.0), F.ceil(F.log2((n + 1).cast("double")))).cast("long") - 1
    packed = F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
    return packed, low


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements. Null and blank texts measure 0 everywhere. Columns of the same names are replaced; all
    others stay, whatever their names. All native: higher-order functions over the words of a row, no shuffle."""
    return _measured(docs, text, MEASURES).select("_doc.*", *MEASURES)


def _measured(docs: DataFrame, text: str, replaced) -> DataFrame:
    """_doc (a struct of the columns of docs but the replaced ones) and the measurements."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in replaced])
    d = docs.select(packed.alias("_doc"), F.col(text).alias("_text"))
    t = F.coalesce(F.col("_text"), F.lit(""))
    d = d.withColumn("_w", spark_words(F.col("_text"))).withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    packed, low = _packed_windows(w, n)
    d = d.withColumn("_low", low)
    d = d.withColumn("_s", F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    s, lo = F.col("_s"), F.col("_low")
    at = lambda j: F.get(s, j).bitwiseAND(lo).cast("int")

    def same(j):
        alike = F.shiftrightunsigned(F.get(s, j).bitwiseXOR(F.get(s, j - 1)).bitwiseAND(F.bitwise_not(lo)), 1) == 0
        words = [F.get(w, at(j) + k) == F.get(w, at(j - 1) + k) for k in range(3)]
        return alike & words[0] & words[1] & words[2]

    d = d.withColumn("_j", F.when(F.size(s) >= 2, F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)).otherwise(F.array().cast("array<int>")))
    j = F.col("_j")
    d = d.withColumn("_p", F.sort_array(F.array_distinct(F.concat(F.transform(j, at), F.transform(j, lambda x: at(x - 1))))))
    p = F.col("_p")
    covered = (F.when(F.size(p) == 0, 0).when(F.size(p) == 1, 3)
               .otherwise(F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda acc, i: acc + F.least(F.lit(3), F.get(p, i) - F.get(p, i - 1)))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("_lines", lines)
    return d.select(
        "_doc", n.cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long").alias("n_letter_words"))


def ledger(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with measurements and `failed_bits`, a long with bit k set where rule k fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    measured = _measured(docs, text, (*MEASURES, "failed_bits")).withColumn("failed_bits", bits)
    # One-element explode: conditions on the results stay above it instead of repeating their expressions below
    return measured.select("_doc", F.explode_outer(F.array(F.struct(*MEASURES, "failed_bits"))).alias("_l")).select("_doc.*", "_l.*")


def mask(policy: Policy, rules=RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[x] for x in policy.rules)


def apply_policy(book: DataFrame, policy: Policy, out: str = "kept", rules=RULES) -> DataFrame:
    """The ledger with a verdict: kept where no enforced rule failed."""
    return book.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(book: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, and documents that only it rejects (kept if the rule were dropped).
    The ledger is first summed per distinct bit pattern, so what follows is at most 2^rules rows."""
    patterns = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    known = {r.name: r.bit for r in rules}
    cells = [F.struct(F.lit(p.version).alias("version"), F.lit(x).alias("rule"), F.lit(1 << known[x]).cast("long").alias("bit"), F.lit(mask(p, rules)).cast("long").alias("mask"))
             for p in policies for x in p.rules]
    each = patterns.withColumn("_c", F.explode(F.array(*cells))).select("failed_bits", "n", "_c.*")
    on = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("documents"), F.sum(F.when(on.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(on == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_only_by_it"), F.sum(F.when(on == 0, F.col("n")).otherwise(0)).alias("kept"))


def verdicts(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """One row per row of docs: measurements, failure bits, the base verdict and the policy's."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(Policy("base", BASE))).cast("long")) != 0
    return (apply_policy(ledger(docs.select("doc_id", "text")), policy).withColumn("base_failed", base)
            .select("doc_id", *MEASURES, "failed_bits", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept")))

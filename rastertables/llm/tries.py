"""Prefix trie of conversations by fixed-length block hashing.

Turns are cut into blocks of BLOCK turns, and conversations are grouped by the digest of all their turns up to each block's
end. A block that every member of its parent group shares needs no more: its turns are read from one member. Only blocks
in which siblings diverge are refined turn by turn. A node is named by its smallest member and its depth, so sums over
subtrees are sums, over a node's members, of what later nodes named after each member add."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import banded_ordinal
from .common import materialize

BLOCK, SPAN, SALTS = 8, 512, 16
#: A third of all rows may be turns of one conversation: turns are numbered in bands of so many turn numbers.
BAND = 4096
HEADS = 9


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), d1, d2 (digest of role and text), bytes (of the text in UTF-8) of every row with a conv.

    Ordered by turn, null first; rows with equal turns by role, then digest. Null roles and texts are empty."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    flat = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"), F.xxhash64(r, t).alias("d1"),
                                                      F.xxhash64(F.lit(1), r, t).alias("d2"), F.octet_length(t).cast("long").alias("bytes"))
    band = F.coalesce(F.floor(F.col("turn") / BAND), F.lit(-(1 << 62)))
    return banded_ordinal(flat, ["conv"], band, [F.asc_nulls_first("turn"), "role", "d1", "d2"], "pos").select("conv", "pos", "d1", "d2", "bytes")


def share_heads(turns: DataFrame, siblings: int = 5, heads: int = HEADS) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % siblings, h = crc32(decimal c) % heads (fewer if
    that has fewer, none if it is absent), and goes on with its own turns after its first h.

    conv, n (turns), and rows conv, pos, d1, d2, bytes: two tables."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    base = F.col("conv") - F.col("conv") % siblings
    plan = lengths.select("conv", "own", base.alias("base"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).alias("h"))
    plan = plan.join(lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_n")), "base", "left")
    plan = materialize(plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("n", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))))
    first = turns.where((F.col("pos") < heads - 1) & (F.col("conv") % siblings == 0)).withColumnRenamed("conv", "base")
    borrowed = plan.select("conv", "base", "k").join(first, "base").where("pos < k").select("conv", "pos", "d1", "d2", "bytes")
    own = turns.join(plan.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "d1", "d2", "bytes")
    return plan.select("conv", "n"), borrowed.unionAll(own)


def _running(rows: DataFrame, key: str, at: str, sums: dict, later: bool = False) -> DataFrame:
    """rows with running values per key in order of `at` (later: of the rows after this one, else of the rows up to this
    one). sums: output name -> (aggregate, column). Spans of SPAN are summed first, so a long key is spread."""
    spans = rows.withColumn("_span", F.floor(F.col(at) / SPAN))
    per_span = spans.groupBy(key, "_span").agg(*[f(c).alias(f"_all_{o}") for o, (f, c) in sums.items()])
    order = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    outer = Window.partitionBy(key).orderBy(order("_span")).rowsBetween(Window.unboundedPreceding, -1)
    before = per_span.select(key, "_span", *[f(f"_all_{o}").over(outer).alias(f"_before_{o}") for o, (f, _) in sums.items()])
    inner = Window.partitionBy(key, "_span").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, -1 if later else Window.currentRow)
    inside = spans.select("*", *[f(c).over(inner).alias(f"_in_{o}") for o, (f, c) in sums.items()])
    join = {F.bit_xor: lambda a, b: a.bitwiseXOR(b), F.sum: lambda a, b: a + b}
    zero = F.lit(0).cast("long")
    out = inside.join(before, [key, "_span"])
    return out.select(*rows.columns, *[join[f](F.coalesce(F.col(f"_in_{o}"), zero), F.coalesce(F.col(f"_before_{o}"), zero)).alias(o) for o, (f, _) in sums.items()])


def _ends(finals: DataFrame) -> DataFrame:
    """depth, q1, q2, sha: SHA-256 of the ascending decimal conv of each node's ending members, joined by commas.

    Ids are sorted and joined in chunks of 4096 consecutive ids; the digest then streams over the chunks of a node."""
    chunks = finals.groupBy("depth", "q1", "q2", F.floor(F.col("conv") / 4096).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        node, digest, done = None, None, []
        for b in batches:
            for d, q1, q2, ids in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if (d, q1, q2) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (d, q1, q2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("depth", "q1", "q2", "sha"), x)) for x in done])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "q1", "q2", "sha"), (*node, digest.hexdigest())))])

    dealt = chunks.repartition("depth", "q1", "q2").sortWithinPartitions("depth", "q1", "q2", "chunk")
    return dealt.select("depth", "q1", "q2", "ids").mapInArrow(run, "depth long, q1 long, q2 long, sha string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of convs (conv, n turns) with turns (conv, pos from 0 without gaps, d1, d2, bytes).

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Conversations without turns are members of the root alone; without conversations there is no node. Equal conversations
    are members of the same nodes, whatever their number. Digests of 128 bits tell prefixes apart."""
    pos, block = F.col("pos"), F.floor(F.col("pos") / BLOCK)
    x1, x2 = F.xxhash64("pos", "d1", "d2"), F.xxhash64(F.lit(1), "pos", "d1", "d2")   # The digest of a prefix is the xor over its turns
    turns = materialize(turns.select("conv", "pos", block.alias("block"), x1.alias("x1"), x2.alias("x2"), "bytes"))
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    blocks = turns.groupBy("conv", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("m"))
    blocks = _running(blocks, "conv", "block", {"q1": (F.bit_xor, "x1"), "q2": (F.bit_xor, "x2")})
    blocks = materialize(blocks.select("conv", "block", (F.col("block") * BLOCK + F.col("m")).alias("depth"), "q1", "q2", F.col("q1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("x2")).alias("p2")))
    # Groups of conversations by successive block digests, each with its parent group's size and smallest member
    groups = materialize(blocks.groupBy("depth", "q1", "q2").agg(F.count("*").alias("n"), F.min("conv").alias("rep"), F.min("block").alias("block"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    above = groups.where(F.col("depth") % BLOCK == 0).select(F.expr(f"depth div {BLOCK}").alias("block"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("n").alias("up_n"), F.col("rep").alias("up"))
    groups = groups.join(above, ["block", "p1", "p2"], "left").withColumn("up_n", F.coalesce("up_n", F.lit(root["n"]).cast("long"))).withColumn("up", F.coalesce("up", F.lit(root["conv"]).cast("long")))
    groups = materialize(groups)
    # A block shared by all members of its parent: one row per turn, from the smallest member
    whole = groups.where("n = up_n").select(F.col("rep").alias("conv"), "block", "n", "up", F.col("depth").alias("end"), "q1", "q2")
    shared = turns.join(whole, ["conv", "block"]).select(
        "conv", (pos + 1).alias("depth"), F.when(pos % BLOCK == 0, F.col("up")).otherwise(F.col("conv")).alias("parent"), "n", "bytes",
        F.when(pos + 1 == F.col("end"), F.col("q1")).alias("q1"), F.when(pos + 1 == F.col("end"), F.col("q2")).alias("q2"))
    # Blocks in which siblings diverge, turn by turn
    parted = groups.where("n < up_n").select("depth", "q1", "q2", "up", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    members = blocks.withColumn("_salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int")).join(parted, ["depth", "q1", "q2", "_salt"]).select("conv", "block", "p1", "p2", "up")
    w = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = turns.join(members, ["conv", "block"]).select("conv", "block", (pos + 1).alias("depth"), "up", "bytes", "x1", "x2",
                                                        F.bit_xor("x1").over(w).bitwiseXOR(F.col("p1")).alias("q1"), F.bit_xor("x2").over(w).bitwiseXOR(F.col("p2")).alias("q2"))
    fine = materialize(fine)
    refined = fine.groupBy("depth", "q1", "q2").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"), F.max("up").alias("up"),
                                                    F.max("x1").alias("x1"), F.max("x2").alias("x2"))
    refined = materialize(refined.select("*", F.col("q1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("x2")).alias("p2")))
    ups = refined.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv").alias("in_block"))
    refined = refined.join(ups, ["depth", "p1", "p2"], "left").select("conv", "depth", F.when((F.col("depth") - 1) % BLOCK == 0, F.col("up")).otherwise(F.col("in_block")).alias("parent"), "n", "bytes", "q1", "q2")
    top = convs.sparkSession.createDataFrame([(root["conv"], 0, None, root["n"], 0, 0, 0)] if root["n"] else [], "conv long, depth long, parent long, n long, bytes long, q1 long, q2 long")
    nodes = materialize(shared.unionByName(refined).unionByName(top))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes")))

    # What the nodes named after a conversation add, after each of its blocks
    node_block = F.expr(f"(depth - 1) div {BLOCK}")
    adds = nodes.where("depth > 0").groupBy("conv", node_block.alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    zero = F.lit(0).cast("long")
    tail = blocks.join(adds, ["conv", "block"], "left").withColumn("leaf", F.coalesce("leaf", zero)).withColumn("saved", F.coalesce("saved", zero))
    tail = materialize(_running(tail, "conv", "block", {"later_leaf": (F.sum, "leaf"), "later_saved": (F.sum, "saved")}, later=True))
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = tail.groupBy("depth", "q1", "q2").agg(F.sum("later_leaf").alias("later_leaf"), F.sum("later_saved").alias("later_saved"))
    sums = groups.where("n = up_n").join(sums, ["depth", "q1", "q2"]).select(F.col("rep").alias("conv"), "block", "later_leaf", "later_saved")
    shared_sums = (nodes.where("depth > 0").withColumn("block", node_block).join(sums, ["conv", "block"])
                   .select("conv", "depth", (F.sum("leaf").over(inside) + F.col("later_leaf")).alias("n_leaves"), (F.sum("saved").over(inside) + F.col("later_saved")).alias("saved_tokens")))
    own = nodes.select("conv", "depth", "leaf", "saved")
    each = fine.select("conv", "block", "depth", "q1", "q2").join(own, ["conv", "depth"], "left").join(tail.select("conv", "block", "later_leaf", "later_saved"), ["conv", "block"])
    each = each.select("conv", "depth", "q1", "q2", (F.sum(F.coalesce("leaf", zero)).over(inside) + F.col("later_leaf")).alias("a"), (F.sum(F.coalesce("saved", zero)).over(inside) + F.col("later_saved")).alias("b"))
    refined_sums = each.groupBy("depth", "q1", "q2").agg(F.min("conv").alias("conv"), F.sum("a").alias("n_leaves"), F.sum("b").alias("saved_tokens")).select("conv", "depth", "n_leaves", "saved_tokens")
    whole_sum = nodes.groupBy().agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(F.lit(root["conv"]).cast("long").alias("conv"), F.lit(0).cast("long").alias("depth"), "n_leaves", "saved_tokens")

    last = blocks.groupBy("conv").agg(F.max_by(F.struct("q1", "q2"), "depth").alias("q"))
    finals = convs.join(last, "conv", "left").select("conv", F.col("n").alias("depth"), F.coalesce("q.q1", zero).alias("q1"), F.coalesce("q.q2", zero).alias("q2"))
    ends = nodes.select("conv", "depth", "q1", "q2").join(_ends(finals), ["depth", "q1", "q2"]).select("conv", "depth", "sha")
    out = nodes.join(shared_sums.unionByName(refined_sums).unionByName(whole_sum), ["conv", "depth"]).join(ends, ["conv", "depth"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))

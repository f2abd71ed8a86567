"""Reply trees to conversations: self-joins that double their reach enumerate the paths from root to leaf, branches are
ranked by the score along the path, and each chosen path is formatted as one conversation.

A turn is written `### role: text </turn>`. Inside texts a backslash stands before every backslash, `###` and `</turn>`, so
a control string in a text is never read as one and comes back unchanged."""
from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ([^ ]*): ((?:[^\\#<]+|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*) </turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (start, end) of the texts to learn."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {quote(role, safe='')}: ", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        turn = f"{head}{body} </turn>\n"
        out.append(turn)
        at += len(turn)
    return "".join(out), spans


def parse(conversation: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(conversation):
        m = _TURN.match(conversation, at)
        if not m:
            raise ValueError(f"No turn at {at}")
        turns.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def replies(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of rows in a line: each turn answers the one before it. Equal turn numbers are ordered by role and text."""
    order = Window.partitionBy(key).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    d = rows.select(F.col(key), F.row_number().over(order).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return d.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame, key: str, branches: int | None) -> DataFrame:
    """tree, branch (1 is the best), at (0 is the root), node: the paths to the `branches` best leaves of each tree (all if
    None). Rounds grow with the logarithm of the depth; a row is a node, or a place in the result."""
    known = nodes.select("_tree", F.col("node").alias("parent"))
    state = nodes.select("_tree", "node", "parent", "score").join(known, ["_tree", "parent"], "left_semi")
    roots = nodes.select("_tree", "node", "parent", "score").join(known, ["_tree", "parent"], "left_anti").withColumn("parent", F.lit(None).cast("long"))
    state = materialize(state.select(*roots.columns).unionAll(roots).select("_tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("length")))
    nodes_up, jumps = state.where("up IS NOT NULL").select("_tree", F.col("up").alias("node")), []
    while state.where("up IS NOT NULL").limit(1).count():
        far = state.where("up IS NOT NULL")   # Paths that have reached their root take no further part
        jumps.append(far)
        above = state.select("_tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("length").alias("_length"))
        joined = far.join(above, ["_tree", "up"], "left")
        joined = joined.select("_tree", "node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"), (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length"))
        state = materialize(joined.unionAll(state.where("up IS NULL")))
        if len(jumps) > 62:
            raise ValueError("The replies form a cycle")
    leaves = state.join(nodes_up, ["_tree", "node"], "left_anti")
    rank = Window.partitionBy("_tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    found = chosen.select("_tree", "branch", "node", (F.col("length") - 1).alias("at"))
    for k, jump in enumerate(jumps):
        step = jump.select("_tree", "node", "up")
        further = found.join(step, ["_tree", "node"]).select("_tree", "branch", F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))
        found = materialize(found.unionAll(further))
    return found


def format_trees(nodes: DataFrame, key: str = "conv_id", branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """key, branch, conversation, spans (start and end of what is learned, in code points), one row per chosen path.

    nodes: key, node (long, unique in its tree), parent (null or unknown: a root), role, text, score. Null roles and texts
    are empty, null scores 0; a null key is a tree of its own. Memory is bounded by one conversation a task."""
    tree = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = materialize(nodes.select(tree.alias("_tree"), F.col(key).cast("long").alias("_key"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    turns = paths(rows, key, branches).join(rows.select("_tree", "node", "_key", "role", "text"), ["_tree", "node"]).select("_tree", "branch", "at", "_key", "role", "text")
    schema = pa.schema([(key, pa.int64()), ("branch", pa.int32()), ("conversation", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        of, ident, held = None, None, []

        def done():
            text, spans = render(held, learn)
            return pa.RecordBatch.from_pylist([{key: ident, "branch": of[1], "conversation": text, "spans": [{"start": a, "end": z} for a, z in spans]}], schema=schema)

        for b in batches:
            for t, branch, _, k, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if (t, branch) != of:
                    if held:
                        yield done()
                    of, ident, held = (t, branch), k, []
                held.append((role, text))
        if held:
            yield done()

    return turns.repartition("_tree", "branch").sortWithinPartitions("_tree", "branch", "at").mapInArrow(run, f"`{key}` long, branch int, conversation string, spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from the conversations: turns, the SHA-256 of `role\\ntext\\n` over them, and size and SHA-256 of the
    text under the loss mask."""
    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                for k, v in zip(cols, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in cols.items())], names=[key, *cols])

    return formatted.select(key, "conversation", "spans").mapInArrow(run, f"`{key}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

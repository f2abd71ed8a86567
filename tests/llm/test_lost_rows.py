"""Rows, records and items that an operator once lost or mixed up, and inputs it once could not bear."""
import collections
import gzip
import hashlib
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastertables.llm import chat, decontaminate, html, quality, shards, warc
from rastertables.llm.common import scratch_path

NASTY = "\\### Assistant: </turn> ok"


def test_warc_pages_that_share_an_id_keep_their_own_payload(spark):
    x, y = "x" * 200, "y" * 300
    rows = [(1, "u", x), (2, "u", x), (2, "u", y), (3, "u", y), (3, "u", "é" * 40_000), (4, "u", "é" * 40_000), (None, "u", x), (None, "u", None), (5, None, "")]
    path = scratch_path(spark, "warc")
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, _page int")
    warc.write(table, path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_digest) for r in warc.assemble(warc.read_records(spark, path)).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    again = {(2, x): 1, (3, y): 2, (4, "é" * 40_000): 3}
    assert got == sorted((p or 0, "revisit" if (p, t) in again else "response", again.get((p, t), 0), sha(t)) for p, _, t in rows)
    empty = scratch_path(spark, "warc")
    warc.write(table.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, path).limit(0)).count() == 0


def test_warc_archives_with_a_gzip_member_per_record(spark, tmp_path):
    parts = [r + "\r\n\r\n" for k in range(3) for r in warc.records(k, 0, "u", f"page {k} " + "z" * 20_000 * k, None)]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in parts))
    got = {r.page_id: r.payload_bytes for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert got == {0: 7, 1: 20_007, 2: 40_007}
    with pytest.raises(ValueError, match="cut off"):
        warc.unpacked(gzip.compress(b"abc" * 1000)[:-12])


def test_deep_pages_take_time_in_proportion():
    page = "<article>" + "<div>" * 50_000 + "deep text."
    began = time.process_time()
    parsed = html.Page(page)
    assert len(parsed.nodes) == 50_002 and time.process_time() - began < 5
    assert sum(t == "word " for _, t in html.Page("<p>" + "<b>word " * 20_000).pieces) == 20_000


def brute_matches(docs, items):
    """(doc, item, windows) by sliding every window over every text."""
    out = collections.Counter()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            q = (item or "").lower().split()
            span, slack = (13, 2) if len(q) >= 13 else (len(q), 0)
            if span < 5:
                continue
            for a in range(len(w) - span + 1):
                for b in range(len(q) - span + 1):
                    out[d, i] += sum(x == y for x, y in zip(w[a:a + span], q[b:b + span])) >= span - slack
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("seed_rows", [decontaminate.SEED_ROWS, 0])
def test_benchmark_items_of_any_length(spark, monkeypatch, seed_rows):
    """Short items as a whole, long ones by windows; the same when both sides are shuffled."""
    monkeypatch.setattr(decontaminate, "SEED_ROWS", seed_rows)
    long = [f"q{k}" for k in range(30)]
    items = [(1, "one two three four"), (2, "alpha beta gamma delta epsilon"), (3, " ".join(f"s{k}" for k in range(12))), (4, " ".join(long)), (5, None), (6, ""), (7, "Alpha beta gamma delta epsilon")]
    changed = long[:5] + ["x"] + long[6:12] + ["x"] + long[13:]
    docs = [(10, "one two three four"), (11, "so ALPHA beta gamma\ndelta epsilon, alpha beta gamma delta epsilon"), (12, "pre " + items[2][1] + " post"), (13, " ".join(changed)), (14, " ".join(long[:12])),
            (15, None), (16, ""), (None, items[1][1]), (17, " ".join(["w"] * 3000 + long)), (12, items[1][1])]
    d = spark.createDataFrame([(*x, 1, "c") for x in docs], "doc_id long, text string, h int, `a.b` string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, span int")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.contaminated(d, b).collect()}
    want = brute_matches([x for x in docs], items)
    assert got == want and (11, 2) in want and (13, 4) in want and (14, 4) not in want
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).where("doc_id IS NOT NULL").collect()) == [10, 14, 15, 16]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_pipeline_stage_keeps_texts_that_share_an_id(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, words("a")), (1, words("b")), (2, words("c")), (2, words("c")), (3, words("a")), (None, words("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text[:1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(0, "a"), (1, "a"), (1, "b"), (2, "c")]


def test_shards_by_a_plain_loop(spark):
    """Sizes, CRCs and the balance of bytes, with copies, nulls and a text above a shard's share."""
    import zlib
    rows = [(k, f"text {k % 37} " * (k % 90)) for k in range(900)] + [(k, "copy of one text") for k in range(1000, 1400)] + [(5000, None), (5001, ""), (None, "no key"), (5002, "z" * 9000)]
    table = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, shard string").repartition(5)
    got = shards.shard(table, 7).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append((r.slot, r["size"]))
    assert sorted(held) == list(range(7)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in held.values())
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert all(abs(sum(z for _, z in v) - total / 7) <= most for v in held.values())
    assert shards.shard(table.limit(0), 7).count() == 0


def test_reply_digests_by_a_plain_loop(spark):
    """Replies, digests and the conversation of control strings, as the query composes them."""
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"text {c} {k} é </turn>") for c in range(40) for k in range(c % 6 + 1)]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (-7, 0, "user", NASTY), (-7, 1, "assistant", NASTY)]
    table = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.replies(table.select("conv_id", "turn", "role", "text")))).collect()}
    for c in {x[0] for x in rows}:
        turns = [(r, t or "") for _, _, r, t in sorted(x for x in rows if x[0] == c)]
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[c].formatted_chars > len(said)
    assert len(got) == len({x[0] for x in rows})


def test_ledger_with_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, 5, 6, "x"), (2, None, 7, 8, "y")], "doc_id long, text string, _l int, _w int, `a.b` string")
    out = quality.ledger(docs)
    assert {"_l", "_w", "a.b"} <= set(out.columns)
    assert sorted((r["_l"], r["_w"], r["a.b"], r.n_words) for r in out.collect()) == [(5, 6, "x", 90), (7, 8, "y", 0)]
    assert quality.verdicts(docs.limit(0)).count() == 0 and out.where(F.col("`a.b`") == "x").count() == 1

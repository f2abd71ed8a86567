"""Prefix trie, ranked search and line removal against brute force: nulls, blanks, ties, repeated rows, empty tables, clashing columns."""
import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from rastertables.llm import lines, search, tries


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Prefix trie

CONV = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """Nodes by definition: rows of (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += worth
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))))) for p, m in members.items())


def spark_trie(table):
    nodes = tries.trie(*tries.share_heads(tries.ordered_turns(table)))
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def test_trie_of_short_long_and_equal_conversations(spark):
    """Lengths up to 40 turns (five blocks), copies, paths that part inside a block, at its border and at its end."""
    r = random.Random(7)
    trunk = [(r.choice(["user", "assistant", None]), r.choice(["", None, "é", "hello", "a longer turn"])) for _ in range(40)]
    rows = []
    for c in range(0, 70):
        n = r.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, 24, 31, 40])
        path = list(trunk[:n])
        if r.random() < 0.5 and n:
            at = r.randrange(n)
            path = path[:at] + [("user", f"own {r.choice([1, 2, 3])}")] + path[at + 1:]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, *x) for k, x in enumerate(path)]
    r.shuffle(rows)
    rows += [(None, 1, "user", "no conversation"), rows[0]]
    table = spark.createDataFrame([(*x, "clash") for x in rows], CONV + ", pos string")
    assert spark_trie(table) == brute_trie(rows)


def test_trie_of_one_copied_conversation_and_of_nothing(spark):
    """Copies have the same own turns; their heads come from other copies, so that all stay equal."""
    rows = [(c, k, "user", f"turn {k}") for c in range(300) for k in range(11)]
    assert spark_trie(spark.createDataFrame(rows, CONV)) == brute_trie(rows)
    assert spark_trie(spark.createDataFrame([], CONV)) == []
    assert spark_trie(spark.createDataFrame([(3, 0, "user", "gone")], CONV)) == brute_trie([(3, 0, "user", "gone")])


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c in counts:
            if i is None or not c:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            score = sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"block": 7, "bundle": 2}, {"asked_terms": 0, "block": 16}, {"top": 3, "owners": (4,), "block": 5}, {"owners": (), "top": 2}])
def test_search_equals_brute_force(spark, how):
    r = random.Random(5)
    vocab = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 20, 90])))) for i in range(150)]
    docs += [(200 + k, docs[9][1]) for k in range(30)] + [(300, None), (301, ""), (302, "--- ++"), (None, docs[3][1]), (5, docs[7][1]), (303, "Éa éa W1-w2 ÉA 九 " * 4000), docs[2]]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(vocab, k=12))) for k in range(9)] + [(20, docs[0][1]), (21, None), (22, "absent words"), (23, "éa w1 w1 Éa 九"), (1, "w2 w3"), (None, "w1")]
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, term string, block int").repartition(3)
    q = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int")
    got = sorted(tuple(x) for x in search.search(d, q, **how).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(docs, items, how.get("top", 20)) and got


def test_search_in_empty_tables_and_by_text_ids(spark):
    d, q = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), spark.createDataFrame([("q", "B c")], "item_id string, text string")
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0
    assert [(x.item_id, x["rank"], x.doc_id) for x in search.search(d, q).orderBy("rank").collect()] == [("q", 1, 2), ("q", 2, 1)]


# Shared lines

def brute_lines(docs, chars=40, docs_at_least=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holds = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= chars:
                holds[key(x)].add(i)
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if i is None or len(holds[key(x)]) < docs_at_least or i == max(holds[key(x)])]
        out.append((-1 if i is None else i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def test_lines_equal_brute_force(spark):
    r = random.Random(9)
    pool = [f"Line number {k} that many documents of this table SHARE é" for k in range(12)] + ["short", "", "   ", "x" * 39, "Y" * 40, "\t" + "y" * 40 + " \r", "Ünïque ÄÖ " * 5]
    docs = [(i, "\n".join(r.choices(pool, weights=[1] * 12 + [3] * 7, k=r.randrange(1, 12)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] + "\n" + pool[1]), (None, pool[0]), docs[5], (7, pool[3] + "\nonly here"), (103, "\n".join([pool[2], "mid"] * 3000))]
    table = spark.createDataFrame([(*x, 1, 2, "c") for x in docs], "doc_id long, text string, n_lines int, salt int, `a.b` string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in lines.digests(table).collect())
    assert got == brute_lines(docs)
    full = lines.apply_bitmaps(table, lines.keep_bitmaps(table))
    assert full.columns == ["doc_id", "text", "salt", "a.b", "n_lines", "n_dropped", "kept_text"] and full.count() == len(docs)
    assert lines.digests(table.limit(0)).count() == 0


def test_a_line_of_every_document_stays_in_the_largest(spark):
    line = "The same licence line in every document of the table."
    table = spark.range(0, 3000, 1, 7).selectExpr("id AS doc_id", f"'{line}\n{line}\nend' AS text")
    assert [r.doc_id for r in lines.digests(table).where("n_dropped = 0").collect()] == [2999]
    maps = lines.keep_bitmaps(table)
    assert {(tuple(map(tuple, r.keep)), r.n_dropped, r.n_lines) for r in maps.collect()} == {(((2, 1),), 2, 3)} and maps.count() == 2999


def test_ranges_need_no_second_exchange_before_the_window(spark):
    table = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    plan = lines.keep_bitmaps(table)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window ")
    assert plan.index("rangepartitioning", window) < plan.index("Exchange", window) + 40 and "Python" not in plan and "Arrow" not in plan

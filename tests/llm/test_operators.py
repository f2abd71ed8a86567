"""Each text operator against a brute-force version, on texts with nulls, blanks, repeats, ties and clashing columns."""
import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from rastertables.llm import bpe, chat, components, counts, decontaminate, html, jaccard, quality, shards, tokens, warc
from rastertables.llm.common import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = " ".join(f"item{k}" for k in range(20))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(400)] + ["It's", "été,", "naïve", "12.5", "##", "THE", "the"]
    long = [" ".join(r.choices(vocab, k=n)) for n in (70, 90, 120, 2500)]
    near = long[2].split(" ")
    near[60] = "changed"
    leak = ITEM.split(" ")
    leak[5] = leak[11] = "x"
    return [None, "", " \n\t ", "one", "two words", "a b c d", *long, long[1], " ".join(near), "x " * 60, "\n".join(["same line here"] * 30),
            long[0] + " " + ITEM, "pre " + " ".join(leak) + " post " + long[3][:300], "  a\x1cb \x85 <|endoftext|> c　\n\n d  ", "aaaa" * 3000, "Ⅷ² é ​, ..", long[3].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "n_words", 1) for i, t in enumerate(texts)] + [(None, "null key text", "x", 2), (7, texts[7], "again", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, failed_bits int")


def test_rule_ledger(docs, texts):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k:k + 3])].append(k)
        repeat = {p + d for v in at.values() if len(v) > 1 for p in v for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_ablations_add_up(docs):
    book = quality.ledger(docs.select("doc_id", "text"))
    for r in quality.ablations(book).collect():
        policy = next(p for p in quality.POLICIES if p.version == r.version)
        assert r.kept == quality.apply_policy(book, policy).where("kept").count()
        fewer = quality.Policy("-", tuple(x for x in policy.rules if x != r.rule))
        assert r.kept + r.rejected_only_by_it == quality.apply_policy(book, fewer).where("kept").count()


def test_decontamination(spark, docs, texts):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.contaminated(docs, items).collect()}
    exp, g = {}, ITEM.split(" ")
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        n = sum(sum(a == b for a, b in zip(w[p:p + 13], g[q:q + 13])) >= 11 for p in range(len(w) - 12) for q in range(len(g) - 12))
        if n:
            exp[i, 1] = n
    assert got == exp and len(exp) == 2
    assert decontaminate.clean(docs, items).count() == docs.count() - 2
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_shards(spark, docs):
    for table, n in ((docs, 3), (docs.limit(0), 3), (spark.createDataFrame([(k, "same") for k in range(500)], "doc_id long, text string"), 7)):
        got = shards.shard(table, n).toPandas()
        assert len(got) == table.count()
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        sizes = got.groupby("shard")["size"].sum()
        if len(got):
            assert sizes.max() - sizes.min() <= 2 * got["size"].max()


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(3000)) and [h.slot(k) for k in keys] == h.slots.tolist()


def test_bpe(docs, texts):
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(docs, path, P.PATTERN).collect()}
    rows = bpe.encode(docs.where("doc_id IS NOT NULL"), path, P.PATTERN)
    ids, back = {r.doc_id: r.ids for r in rows.collect()}, {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        x = enc.encode_ordinary(t or "")
        assert ids[i] == x and back[i] == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)


def test_code_lengths():
    for counts_, longest in (([1], 18), ([5, 1], 18), ([1, 1, 2, 4, 8, 16, 32], 4), (list(range(1, 300)), 18)):
        n = tokens.code_lengths(np.array(counts_), longest)
        assert n.max() <= longest and (len(n) == 1 or sum(2.0 ** -n) == 1.0)


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = scratch_path(spark, "tokens")
    tokens.write(tokens.encode_words(docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL"), P.path("word_bpe_49k.json")), path)
    got, start = {r.doc_id: r for r in tokens.checksums(tokens.read(spark, path)).collect()}, 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def linked(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sets, root


def test_jaccard_join(spark, texts):
    r = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    group = [" ".join(w if r.random() > p else f"e{r.random()}" for w in base) for p in (0, .005, .01, .02, .03) for _ in range(30)]
    rows = texts + group + ["hot copy of a text with some words in it"] * 60
    table = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)] + [(None, "no key", 1)], "doc_id long, text string, n_shingles int")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(table).collect()}
    sets, root = linked(rows)
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, root))}
    assert jaccard.join(table.limit(0)).count() == 0


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100 + k, 100) for k in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "v long, u long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 300)}


def test_html(spark):
    page = "<html><body><nav><ul><li><a href=x>Menu</a><li>B</ul></nav><div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<br>Next<p>Second&nbsp;one.<div class=comments>Nice!</div></article><footer>(c)</footer><script>var t='</p>'</script>"
    pages = spark.createDataFrame([(k, "u", page) for k in range(20)] + [(90, None, None), (91, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages, html.train(pages)).collect()}
    want = "Title & more First bold text. Next Second one."
    assert got[3] == (want, len(want)) and got[90] == got[91] == ("", 0)
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


def test_html_held_out(spark):
    """Trained on every second page of a test table, right on the others: the article cut out of the markup by patterns, which
    share no code with the operator, is the expected text."""
    import html as entities
    rows = [(r.page_id, r.html or "") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string")
    model = html.train(pages.where("page_id % 2 = 0"))
    got = {r.page_id: r.text for r in html.extract(pages.where("page_id % 2 = 1"), model).collect()}
    wrong = 0
    for k, h in rows:
        if k % 2 == 1:
            inside = " ".join(re.findall(r"<article>(.*?)</article>", h, re.S))
            blocks = re.sub(r"</?(?:p|br|h1|div)\b[^>]*>", " ", inside)
            wrong += got[k] != " ".join(entities.unescape(re.sub(r"<[^>]*>", "", blocks)).split())
    assert len(got) >= 20 and wrong <= 0.02 * len(got)


def test_tree_marginals_are_exact():
    model = html.Model({"0 node": 9, "1 node": 9, "1 tag p": 5, "0 tag li": 6, "1 under 1": 6, "0 under 1": 2, "0 under 0": 5, "1 under 0": 1})
    nodes = [html.Node("div", -1, ()), html.Node("p", 0, ()), html.Node("li", 0, ()), html.Node("p", 2, ())]
    total, on = 0.0, [0.0] * 4
    for bits in range(16):
        y = [bits >> k & 1 for k in range(4)]
        p = 1.0
        for k, n in enumerate(nodes):
            e = 1 / (1 + np.exp(-sum(model.odds.get(f, 0) for f in html.features(n))))
            p *= e if y[k] else 1 - e
            if n.parent >= 0:
                p *= model.to[y[n.parent]][y[k]]
        total += p
        on = [a + p * b for a, b in zip(on, y)]
    assert np.allclose(model.marginals(nodes), [a / total for a in on])


def test_chat_round_trip_and_branches(spark):
    nasty = ["", "\\### Assistant: </turn> ok", "###", "####\\", "\\\\</turn> </turn>", "a\n### user: b </turn>\n", "#", "<"]
    turns = [("user" if k % 2 else "assistant", t) for k, t in enumerate(nasty)] + [("odd role:\n", "x")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:z]) for a, z in spans] == nasty[::2]
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "thanks", 0.0), (2, 1, None, None, None, None), (None, 5, 99, "user", "lost", 1.0)]
    table = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.branch): [t for _, t in chat.parse(r.conversation)] for r in chat.format_trees(table, branches=2).collect()}
    assert got == {(1, 1): ["q", "good", "thanks"], (1, 2): ["q", "bad"], (2, 1): [""], (None, 1): ["lost"]}


def test_warc(spark):
    long = "é" * 30_000
    rows = [(3, "http://a/ b", long), (1, "u", long), (2, None, None), (5, "u", "short"), (4, "u", "short"), (None, "u", "x" * 200), (9, "u", "WARC/1.1\r\n\r\n" * 20), (1, "u", long)]
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, path)
    read = warc.read_records(spark, path)
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc.assemble(read, True).collect())
    assert got == sorted(((p or -1, len((h or "").encode()), "revisit" if p == 3 else "response", 1 if p == 3 else None, None if p == 3 else h or "") for p, _, h in rows), key=lambda x: x[:3])
    with pytest.raises(Exception, match="not complete"):
        warc.assemble(read.where("segment IS NULL OR segment <> 2")).collect()


def test_pipeline(spark, docs, texts, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect() if r.doc_id is not None}
    left = sorted(kept)
    _, root = linked([texts[i] for i in left])
    first = {left[k] for k in set(root)}
    want = {i for i in first if ITEM not in (texts[i] or "") and "item4 x item6" not in (texts[i] or "")}
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and 14 in first and 14 not in want


def test_word_ids_equal_the_library(monkeypatch):
    """Whole texts by the library against word by word, with marks that normalising moves, and with a full memory."""
    path = P.path("word_bpe_49k.json")
    texts = ["İ. İ&& a̸< x≮ क़!! don't' it's... <|endoftext|>! a<|endoftext|>b יִ, Å., 12,3!", "a\x1cb c\x1f\x1f!", "", "　x\x85y, .", "x" * 100 + "!", "ΑΣ, ΑΣ Σ. é, é, ́ ﬁ! ǅ,", "Word, word WORD. " * 50]
    for kept in (700_000, 5):
        monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
        words = tokens.WordIds(path, 2)
        for _ in range(2):
            for text in texts:
                assert np.frombuffer(words.text(text), words.kind).tolist() == words.tok.encode(text, add_special_tokens=False).ids + [2]
            assert len(words) <= kept


def test_words_of_latin_letters_equal_the_library():
    words = tokens.WordIds(P.path("word_bpe_49k.json"), None)
    r = random.Random(1)
    chars = [chr(c) for c in range(33, 0x260)] + list("Σσς\u0301—𝐀")
    for _ in range(5000):
        w = "".join(r.choices(chars, k=r.randrange(1, 6)))
        if not w.isspace():
            assert np.frombuffer(words.text(w), words.kind).tolist() == words.tok.encode(w, add_special_tokens=False).ids, w


@pytest.mark.parametrize("wide", [False, True])
def test_token_files_of_any_ids_keys_and_lengths(spark, wide):
    """Null and repeated keys, documents without ids, ids above 16 bits, one document beyond a coding call; an empty table."""
    r = np.random.default_rng(4)
    top = 200_000 if wide else 60_000
    docs = [(None if k % 7 == 0 else k // 2, (r.geometric(0.001, size=n) * 17) % top) for k, n in enumerate([0, 1, 127, 128, 129, 700_000, 5, 0, 3000, 300, 300, 64] * 5)]
    kind = tokens.id_type(wide)
    rows = spark.createDataFrame([(k, len(x), x.astype(kind).tobytes()) for k, x in docs], "doc_id long, n_tokens long, ids binary").repartition(3)
    path = scratch_path(spark, "tokens")
    tokens.write(rows, path, wide=wide)
    got = tokens.read(spark, path).orderBy("start", "n_tokens").collect()
    want = collections.Counter((k, x.astype(kind).tobytes()) for k, x in docs)
    assert collections.Counter((g.doc_id, bytes(g.ids)) for g in got) == want
    starts = np.cumsum([0] + [g.n_tokens for g in got])
    keys = [-1 if g.doc_id is None else g.doc_id for g in got if g.n_tokens]
    assert [g.start for g in got] == starts[:-1].tolist() and keys == sorted(keys)
    empty = scratch_path(spark, "tokens")
    tokens.write(rows.limit(0), empty, wide=wide)
    assert tokens.checksums(tokens.read(spark, empty), wide=wide).count() == 0

"""The registered queries of the text operators, with the SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, counts, decontaminate, html, jaccard, lines, quality, search, shards, tokens, tries, warc
from .common import materialize, scratch_path, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

CONTAMINATED_SQL = f"""
WITH d AS (SELECT doc_id, list_transform({WORDS.format(t='text')}, lambda x: lower(x)) AS w FROM {{docs}}),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d WHERE len(w) >= 13),
b AS (SELECT item_id, list_transform({WORDS.format(t='text')}, lambda x: lower(x)) AS w FROM benchmark),
bw AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS q FROM b WHERE len(w) >= 13),
size_d AS (SELECT doc_id, len(w) AS n FROM d), size_b AS (SELECT item_id, len(w) AS n FROM b),
same AS (SELECT doc_id, item_id, p - q AS diag, q FROM dw JOIN bw USING (word)),
near AS (SELECT doc_id, item_id, diag, list(q) AS qs FROM same GROUP BY ALL HAVING count(*) >= 11),
starts AS (SELECT doc_id, item_id, diag, qs, unnest(range(greatest(0, -diag), size_b.n - 12)) AS s FROM near JOIN size_b USING (item_id)),
wins AS (SELECT doc_id, item_id, diag, s, len(list_filter(qs, lambda x: x >= s AND x < s + 13)) AS eq FROM starts JOIN size_d USING (doc_id) WHERE s + diag + 13 <= size_d.n)
SELECT doc_id, item_id, count(*) AS n_windows, max(eq) AS best_equal, min(s + diag) AS first_word, max(s + diag) + 12 AS last_word
FROM wins WHERE eq >= 11 GROUP BY doc_id, item_id"""


@query("op1_spaced_seed_decontamination", CONTAMINATED_SQL.replace("{docs}", "documents"))
def op1(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LEDGER_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(t='text')} AS w FROM {{docs}}),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, list_transform(range(greatest(0, len(w) - 2)), lambda i: [w[i + 1], w[i + 2], w[i + 3]]) AS g FROM d),
gw AS (SELECT doc_id, unnest(g) AS gram, unnest(range(len(g))) AS i FROM l),
rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM gw) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')))::BIGINT AS n_letter_words FROM l LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END
  + CASE WHEN 10 * n_letter_words < 4 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b"""


@query("op2_rule_bitmask_ledger", LEDGER_SQL.replace("{docs}", "documents"))
def op2(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents"))


@query("rule_ablations", f"""
WITH led AS ({LEDGER_SQL.replace("{docs}", "documents")}), pol(version, rule, bit, mask) AS (VALUES ('v1', 'few_words', 1, 3), ('v1', 'repeated_trigrams', 2, 3),
 ('v2', 'few_words', 1, 23), ('v2', 'repeated_trigrams', 2, 23), ('v2', 'symbols', 4, 23), ('v2', 'repeated_lines', 16, 23), ('v3', 'few_words', 1, 63), ('v3', 'repeated_trigrams', 2, 63),
 ('v3', 'symbols', 4, 63), ('v3', 'word_length', 8, 63), ('v3', 'repeated_lines', 16, 63), ('v3', 'letterless_words', 32, 63))
SELECT version, rule, count(*) AS documents, sum(CASE WHEN failed_bits & mask & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS fails,
 sum(CASE WHEN failed_bits & mask = bit THEN 1 ELSE 0 END)::BIGINT AS rejected_only_by_it, sum(CASE WHEN failed_bits & mask = 0 THEN 1 ELSE 0 END)::BIGINT AS kept
FROM led, pol GROUP BY version, rule""")
def rule_ablations(spark, sf_dir):
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op3_sampled_splitters")
def op3(spark, sf_dir):
    s = shards.shard(table(spark, sf_dir, "documents"), 40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_two_tier_bpe")
def op4(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_multi_match_jaccard")
def op5(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op6_tree_model_html")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


@query("op7_reply_tree_chat")
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.replies(rows.unionAll(more))))


@query("op8_warc_segments")
def op8(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.assemble(warc.read_records(spark, path)).drop("payload")


@query("op9_map_side_token_counts")
def op9(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_huffman_token_files")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path, vocabulary = scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    wide = tokens.is_wide(vocabulary)
    ids = materialize(tokens.encode_words(docs, vocabulary))
    tokens.write(ids, path, wide=wide)
    return tokens.checksums(tokens.read(spark, path), wide=wide)

@query("op13_line_keep_bitmaps", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""")
def op13(spark, sf_dir):
    return lines.digests(table(spark, sf_dir, "documents"))


CRC32_SQL = """list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
 lambda acc, b: list_reduce([xor(acc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


@query("op11_block_hash_trie", f"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor({CRC32_SQL}, 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
borrowed AS (SELECT c.conv_id, t.pos, t.h, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h),
own AS (SELECT t.conv_id, 1000000 + t.pos AS pos, t.h, t.bytes FROM t JOIN c USING (conv_id) WHERE t.pos >= c.h),
r AS (SELECT conv_id, list(h ORDER BY pos) AS hs, list(bytes ORDER BY pos) AS bs FROM (FROM borrowed UNION ALL FROM own) GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(hs, []) AS hs, coalesce(bs, []) AS bs FROM c LEFT JOIN r USING (conv_id)),
m AS (SELECT conv_id, depth, md5(array_to_string(hs[1:depth], ',')) AS k, CASE WHEN depth = 0 THEN 0 ELSE bs[depth] END AS bytes, len(hs) = depth AS ended,
  CASE WHEN depth > 0 THEN md5(array_to_string(hs[1:depth - 1], ',')) END AS pk FROM (SELECT *, unnest(range(len(hs) + 1)) AS depth FROM a)),
n AS (SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended) AS ids FROM m GROUP BY depth, k),
p AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.k = n.pk),
kids AS (SELECT pk, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids ON kids.pk = p.k AND kids.depth = p.depth),
s AS (SELECT m.depth, m.k, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n_convs - 1) * q.bytes) AS saved_tokens FROM q JOIN m ON m.conv_id = q.conv_id AND m.depth <= q.depth GROUP BY ALL)
SELECT q.conv_id, q.depth::BIGINT AS depth, q.parent_conv_id, q.n_convs, q.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
 sha256(coalesce(q.ids, '')) AS ends_sha256 FROM q JOIN s USING (depth, k)""")
def op11(spark, sf_dir):
    turns = materialize(tries.ordered_turns(table(spark, sf_dir, "conversations")))
    return tries.trie(*tries.share_heads(turns))


@query("op12_pipelined_term_search", """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT *, len(w) AS n FROM t WHERE len(w) > 0), s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
c AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS gain FROM f JOIN c USING (term), s),
r AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(times * gain) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r)
SELECT * FROM k WHERE rank <= 20""")
def op12(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

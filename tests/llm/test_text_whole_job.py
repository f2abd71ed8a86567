"""Cases in which an operator once did less than its whole job, against brute force."""
import random

import pytest

import corpus_pipeline
from rastertables.llm import jaccard


def brute_links(texts, words, percent):
    """Set sizes, component roots and linked documents of single-spaced lower-case texts."""
    sets = []
    for t in texts:
        w = t.split(" ")
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))})
    root, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sets, root, links


@pytest.mark.parametrize("hot_count, light", [(1, 1), (1, jaccard.LIGHT)])
def test_every_salt_of_a_hot_shingle_is_heavy(spark, hot_count, light):
    """A passage all documents hold, so that every prefix shingle is hot; some documents fall on each salt alone."""
    r = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = [" ".join(base[:k] + [f"own{n}"] + base[k + 1:]) for n in range(200) for k in [r.choice([0, 59])]]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.join(table, hot_count=hot_count, light=light).collect()}
    _, root, links = brute_links(rows, jaccard.WORDS, jaccard.PERCENT)
    assert got == {i: (c, n) for i, (c, n) in enumerate(zip(root, links))}


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark):
    """Pairs of 50 words with one changed inside: 41 of 51 shingles of five words, 43 of 51 of four (no link at 85)."""
    rows = []
    for n in range(4):
        w = [f"t{n}w{k}" for k in range(50)]
        rows += [" ".join(w), " ".join(w[:20] + ["changed"] + w[21:])]
    rows += ["one two three four", "one two three four", "one two three other", " ".join(f"last{k}" for k in range(9))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in jaccard.join(docs, percent=80, words=5).collect()}
    sets, root, links = brute_links(rows, 5, 80)
    assert got == {i: (len(s), c, n) for i, (s, c, n) in enumerate(zip(sets, root, links))}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(root)) == [0, 2, 4, 6, 8, 10, 11]

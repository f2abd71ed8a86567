"""Families of the near-duplicate join whose sets were once compared all with all for a few common phrases."""
import random

import numpy as np
from pyspark.sql import functions as F

from rastertables.llm import jaccard


def test_common_phrases_do_not_chain_texts_into_one_family(spark, monkeypatch):
    """400 texts of 100 own words and ten of 200 phrases, and a sketch so full that every shingle looks rare. Twenty texts
    have a near copy and a group of 80 are near copies of each other."""
    r = random.Random(7)
    phrases = [[f"p{n}w{k}" for k in range(6)] for n in range(200)]
    words = lambda n: sum([phrases[k] for k in r.sample(range(200), 10)], []) + [f"own{n}w{k}" for k in range(100)]
    texts = [words(n) for n in range(400)]
    texts += [[*t[:-1], "other"] for t in texts[:20]]
    same = words(400)
    texts += [[*same[:-1], f"last{n}"] for n in range(80)]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "sketch", lambda profile: np.full(1 << jaccard.SKETCH_BITS, 1000))
    compared, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda families, *rest: compared.append(families) or verify(families, *rest))

    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.join(docs, light=3).collect()}

    one = {n: (n, 0) for n in range(20, 400)}
    two = {n: (n % 400, 1) for n in (*range(20), *range(400, 420))}
    assert got == one | two | {n: (420, 79) for n in range(420, 500)}
    largest = compared[0].groupBy("family").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert 80 <= largest < 200, "unrelated texts are compared all with all"

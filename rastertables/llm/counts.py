"""Token counts with a two-tier lookup on the map side: a compact table of the lengths of frequent chunks travels to every
worker; what it lacks is encoded by the tokenizer library and remembered by the worker. No pre-token is ever shuffled."""
from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Remembered, per_chunk

ENTRIES, CHARS, SAMPLE_ROWS = 32_768, 24, 4_096


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class FrequentLengths:
    """Chunks and their token counts as three flat buffers: at most ENTRIES chunks of CHARS characters, some 2 MB."""

    def __init__(self, lengths: dict[str, int]):
        keys = [k.encode() for k in lengths]
        self.keys = b"".join(keys)
        self.ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        self.counts = np.array(list(lengths.values()), np.uint8 if max(lengths.values(), default=0) < 256 else np.int64)

    def table(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.keys[a:b].decode(): n for a, b, n in zip([0, *ends], ends, self.counts.tolist())}


class Counter2:
    """Counts the tokens of texts: first the frequent lengths, then the worker's memory, then the library."""

    def __init__(self, path: str, frequent: FrequentLengths):
        self.tok = library(path)
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("Added tokens that look at their neighbours are not supported")
        special = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memory = Remembered(self.encode)
        self.bare, self.spaced = Lookup(self.memory, ""), Lookup(self.memory, " ")
        for chunk, n in frequent.table().items():
            self.bare[chunk] = n
            if chunk[:1] == " " and len(chunk) > 1:
                self.spaced[chunk[1:]] = n

    def encode(self, chunk: str) -> int:
        core = chunk[:-1]
        if chunk[-1:] in ".,;:!?" and (core[1:] if core[:1] == " " else core).isalpha():   # A word and a mark are two pieces
            return self.memory[core] + self.memory[chunk[-1]]
        return len(self.tok.encode(chunk, add_special_tokens=False))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(per_chunk(text, self.bare, self.spaced))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(per_chunk(x, self.bare, self.spaced)) for x in parts)


class Lookup(dict):
    """First tier; misses go to the worker's memory under the whole chunk."""

    def __init__(self, memory: dict, lead: str):
        super().__init__()
        self.memory, self.lead = memory, lead

    def __missing__(self, key):
        return self.memory[self.lead + key]


class ChunkTally(dict):
    def __missing__(self, key):
        return key


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", entries: int = ENTRIES, chars: int = CHARS, sample_rows: int = SAMPLE_ROWS) -> FrequentLengths:
    """The commonest chunks of about sample_rows rows, with their token counts. The sample only decides what is looked up
    fast; no count depends on it. Each task reports its `entries` commonest chunks at most."""
    def run(batches):
        tally: Counter = Counter()
        same, spaced = ChunkTally(), Spaced()
        for b in batches:
            for t in b.column(0).to_pylist():
                tally.update(per_chunk(t or "", same, spaced))
        top = [(k, n) for k, n in tally.most_common(entries) if k and len(k) <= chars]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(top, columns=["chunk", "n"]).astype({"chunk": "str", "n": "int64"}), schema=pa.schema([("chunk", pa.string()), ("n", pa.int64())]), preserve_index=False)

    step = max(1, docs.count() // sample_rows)
    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(step)) == 0)
    top = sample.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(entries)
    tok = library(path)
    return FrequentLengths({r.chunk: len(tok.encode(r.chunk, add_special_tokens=False)) for r in top.collect()})


class Spaced(dict):
    def __missing__(self, key):
        return " " + key


_COUNTERS: dict[tuple, Counter2] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit of every row, as the tokenizer library counts the whole text without
    begin and end tokens. Null texts count 0. A repeated key gives a row each time."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text))
    mark = (path, uuid.uuid4().hex)

    def run(batches):
        if mark not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[mark] = Counter2(path, frequent.value)
        counter = _COUNTERS[mark]
        for b in batches:
            n = [counter.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(key, F.col(text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

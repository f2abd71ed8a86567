"""Byte-level BPE by rank files: encoding and decoding in the workers, without a shuffle.

Whole pre-tokens that are in the vocabulary are resolved by a minimal perfect hash; the others are merged from single bytes
held in a linked list, always the pair of lowest rank first, with the open pairs in a heap. A worker remembers what it has
encoded by chunk: a run of non-white characters with the space before it. No pre-token of the split pattern crosses a
chunk border, so the pieces of a text are the pieces of its chunks."""
from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Remembered, explicit_pattern, per_chunk

ROWS_PER_BATCH = 256


class PerfectHash:
    """Minimal perfect hash by displacement: keys are dealt to buckets; each bucket, fullest first, gets a displacement that
    sends its keys to free slots; buckets of one key store their slot itself as a negative number."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("Two keys share a hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        free = np.ones(n, bool)
        shift = np.zeros(self.buckets, np.int64)
        slots = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b]:starts[b + 1]]
            if len(own) < 2:
                break
            start, span = 0, 16
            while True:
                tries = np.arange(span, dtype=np.uint64)
                at = self._slot(hashes[own][None, :], tries[:, None] + np.uint64(start))
                good = free[at].all(1)
                ordered = np.sort(at, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    d = int(np.argmax(good))
                    shift[b], slots[own] = start + d, at[d]
                    free[at[d]] = False
                    break
                start, span = start + span, min(4096, 4 * span)
        left = iter(np.nonzero(free)[0].tolist())
        for b in np.nonzero(sizes == 1)[0]:
            slots[order[starts[b]]] = s = next(left)
            shift[b] = -s - 1
        self.shift = shift.tolist()
        self.slots = slots

    def _slot(self, h, d):
        """Slot of hash h under displacement d; the same integer arithmetic as in slot()."""
        with np.errstate(over="ignore"):
            mixed = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            return -d - 1
        mixed = ((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (mixed >> 32) % self.n


class Ranks:
    """A rank file: token bytes and ids, the perfect hash over them, and the merge of whatever is not in it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(t): int(i) for t, i in pairs}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.dtype = np.dtype("<u2" if len(self.bytes_of) <= 1 << 16 else "<u4")
        keys = list(self.rank)
        self.hash = PerfectHash(keys)
        self.key_at, self.id_at = [b""] * len(keys), [0] * len(keys)
        for k, s in zip(keys, self.hash.slots.tolist()):
            self.key_at[s], self.id_at[s] = k, self.rank[k]
        self.split = regex.compile(explicit_pattern(pattern))
        self.pair = {}
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = i
        self.of_byte = [self.rank[bytes([i])] for i in range(256)]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.bare, self.spaced = Remembered(self.encode_chunk), Remembered(lambda word: self.encode_chunk(" " + word))
        self.pieces = Remembered(self.piece)

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token: first tier the perfect hash, second tier the merge."""
        key = text.encode()
        s = self.hash.slot(key)
        return array(self.code, (self.id_at[s],) if self.key_at[s] == key else self.merge(key)).tobytes()

    def merge(self, key: bytes) -> list[int]:
        """Ids of the bytes after all merges. ids, after and before are the linked list; rank_at[i] is the rank of the pair
        that starts at i, so an entry of the heap is stale when it differs."""
        get, n, of_byte = self.pair.get, len(key), self.of_byte
        ids = [of_byte[c] for c in key]
        rank_at = [get(ids[i] << 20 | ids[i + 1], -1) for i in range(n - 1)]
        heap = [r << 40 | i for i, r in enumerate(rank_at) if r >= 0]
        rank_at.append(-1)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            if rank_at[i] != r:
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], rank_at[j], after[i] = r, -1, -1, k
            q = -1
            if k < n:
                before[k] = i
                q = get(r << 20 | ids[k], -1)
                if q >= 0:
                    push(heap, q << 40 | i)
            rank_at[i] = q
            p = before[i]
            if p >= 0:
                rank_at[p] = q = get(ids[p] << 20 | r, -1)
                if q >= 0:
                    push(heap, q << 40 | p)
        return [x for x in ids if x >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as packed integers."""
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():   # Letters alone are one pre-token
            return self.pieces[chunk]
        return b"".join(map(self.pieces.__getitem__, self.split.findall(chunk)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(per_chunk(text, self.bare, self.spaced)), self.dtype)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every row; null texts have none. Other columns are left out: join them back by key."""
    def run(batches):
        r = ranks(path, pattern)
        for b in batches:
            for s in range(0, b.num_rows, ROWS_PER_BATCH):
                part = b.slice(s, ROWS_PER_BATCH)
                ids = [r.encode(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (binary): the bytes the ids stand for."""
    def run(batches):
        r = ranks(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=[key, "decoded"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep what identifies both: n_tokens, the SHA-256 of the ids in decimal joined by
    one space, and the SHA-256 of the decoded bytes. Ids never leave the worker, so nothing wide is written."""
    def run(batches):
        r = ranks(path, pattern)
        digits = list(map(str, range(len(r.bytes_of))))
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1):
                ids = r.encode(t.as_py() or "").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(r.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(key, F.col(text))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

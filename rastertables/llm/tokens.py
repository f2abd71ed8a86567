"""Token-id files: ids in a canonical, length-limited Huffman code built from the counts of the whole corpus.

A file set is two Parquet tables. `code`: the code length of every id in use, and whether ids take 32 bits. `blocks`: rows in ascending key order, each
an independent block of whole documents with the number of ids before it, the documents' keys and lengths, the bit stream
and the bit offset of every STEP-th id (checkpoints), from which all stretches are decoded side by side by table."""
from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import WHITE

LONGEST, STEP, BLOCK_IDS = 18, 128, 1 << 18
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEPARATORS = "\x1c\x1d\x1e\x1f"   # White space for str.split, not for the tokenizer
#: Remembered words, the share of them that may be words with marks, the longest one, ids coded and
#: documents handled in one call.
KEPT_WORDS, KEPT_CHARS, CALL_IDS, CALL_ROWS = 300_000, 32, 1 << 19, 500
#: Key ranges are cut this many times finer than tasks, then joined to tasks of about equal numbers of ids.
FINER = 8
#: Letters below this code point are in normal form and have lower-case letters of their own.
LATIN = "\u0250"


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def id_type(wide: bool) -> str:
    """Ids are held in 16 bits, or 32 where the vocabulary needs more."""
    return "<u4" if wide else "<u2"


class WordIds(dict):
    """Ids of words as the tokenizer library gives them, word by word: its split drops white space and no rule looks across
    it. A word is letters and the marks behind them, which are two pieces; the letters go straight to the library's model,
    everything else through all of the library. Up to KEPT_WORDS words of at most KEPT_CHARS characters (some 50 MB) are
    remembered, bare words first; the words met first are the frequent ones."""

    def __init__(self, path: str, end: int | None):
        import re
        super().__init__()
        self.tok = library(path)
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.kind = id_type(self.wide)
        self.pieces = self.tok.model.tokenize
        self.words = re.compile(f"[^{WHITE}]+")
        self.end = b"" if end is None else np.array([end], self.kind).tobytes()
        # The library spells bytes that are no visible characters by characters from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(visible)))}

    def packed(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()   # As machines of little-endian order hold them

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        low = core.lower()
        # In lower case, a letter may be a letter and a mark, which joins the marks behind it
        if not (low.isascii() or max(core) < LATIN) or not low.isalpha():
            value = self.packed(self.tok.encode(word, add_special_tokens=False).ids)
        elif len(core) < len(word):
            value = self[low] + self.marks(word[len(core):])
            if len(self) > KEPT_WORDS // 2:
                return value
        elif low != word:
            value = self[low]
        else:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.spelt)
            value = self.packed([t.id for t in self.pieces(spelt)])
        if len(self) < KEPT_WORDS and len(word) <= KEPT_CHARS:
            self[word] = value
        return value

    def marks(self, marks: str) -> bytes:
        if marks not in self:   # Never taken for a word: its first character is no letter
            value = self.packed(self.tok.encode(marks, add_special_tokens=False).ids)
            if len(self) >= KEPT_WORDS or len(marks) > KEPT_CHARS:
                return value
            self[marks] = value
        return self[marks]

    def text(self, text: str) -> bytes:
        words = self.words.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.__getitem__, words)) + self.end


@lru_cache(maxsize=4)
def word_ids(path: str, end: int | None) -> WordIds:
    return WordIds(path, end)


def encode_words(docs: DataFrame, path: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (little endian, 16 bits, or 32 for vocabularies above 65,536) of every row; null texts hold the
    end id only."""
    def run(batches):
        w = word_ids(path, end)
        size = 4 if w.wide else 2
        for b in batches:
            for at in range(0, len(b), CALL_ROWS):   # Results leave in small batches, however large those of Spark are
                part = b.slice(at, CALL_ROWS)
                out = [w.text(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // size for x in out], pa.int64()), pa.array(out, pa.binary())], names=[key, "n_tokens", "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def is_wide(path: str) -> bool:
    return library(path).get_vocab_size() > 1 << 16


def id_counts(rows: DataFrame, ids: str = "ids", wide: bool = False) -> DataFrame:
    """id and n over the whole table; each task reports an id once."""
    kind = id_type(wide)

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for at in range(0, len(b), CALL_ROWS):
                n = np.bincount(np.frombuffer(b"".join(b.column(0).slice(at, CALL_ROWS).to_pylist()), kind), minlength=len(total))
                total = n + (np.pad(total, (0, len(n) - len(total))) if len(n) > len(total) else total)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    return rows.select(ids).mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; counts are positive."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError("More symbols than codes")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    w = counts[order].astype(np.int64)
    levels, items = [], w
    symbol = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(symbol)
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, pairs])
        by = np.argsort(both, kind="stable")
        items, symbol = both[by], by < n
    levels.append(symbol)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for symbol in reversed(levels):
        s = int(symbol[:take].sum())
        lengths[:s] += 1
        take = 2 * (take - s)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical code: ids sorted by (length, id) take consecutive code words."""
    ids: np.ndarray
    lengths: np.ndarray
    wide: bool = False

    def __post_init__(self):
        order = np.lexsort((self.ids, self.lengths))
        self.ids, self.lengths = self.ids[order], self.lengths[order]
        span = np.left_shift(1, LONGEST - self.lengths)
        first = np.cumsum(span) - span
        most = max(int(self.ids.max(initial=0)) + 1, 1 << 16)
        self.code_of, self.bits_of = np.zeros(most, np.uint32), np.zeros(most, np.int64)
        self.code_of[self.ids] = first >> (LONGEST - self.lengths)
        self.bits_of[self.ids] = self.lengths
        self.kind = id_type(self.wide)
        self.id_at, self.bits_at = np.zeros(1 << LONGEST, self.kind), np.ones(1 << LONGEST, np.uint8)
        total = int(span.sum())
        self.id_at[:total], self.bits_at[:total] = np.repeat(self.ids, span), np.repeat(self.lengths, span)

    def encode(self, ids: np.ndarray, n: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """For consecutive documents of n ids each: the bit stream and the bit offset of every STEP-th id. Every document
        begins with a byte of its own."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        last = np.cumsum(n)
        before = np.concatenate([[0], ends])[last - n]
        sizes = (np.concatenate([[0], ends])[last] - before + 7) // 8
        byte_ends = np.cumsum(sizes)
        local = ends - bits - np.repeat(before, n)   # Bit offset inside the document
        at = local + 8 * np.repeat(byte_ends - sizes, n)
        word = self.code_of[ids].astype(np.int64) << (32 - bits - (at & 7))
        byte, total = at >> 3, int(byte_ends[-1]) + 4 if len(n) else 4
        out = np.zeros(total)
        for k in range(4):   # Code words never overlap, so adding is setting bits
            out += np.bincount(byte + k, weights=(word >> (24 - 8 * k)) & 255, minlength=total)[:total]
        stream = out.astype(np.uint8).tobytes()
        return [(stream[e - z:e], local[l - k:l:STEP]) for e, z, l, k in zip(byte_ends.tolist(), sizes.tolist(), last.tolist(), n.tolist())]

    def decode(self, stream: bytes, n: np.ndarray, checkpoints: np.ndarray) -> np.ndarray:
        """The ids of consecutive documents of n ids each. All stretches between checkpoints advance side by side: one table
        look-up gives id and length."""
        stretches = -(-n // STEP)
        left = np.repeat(n, stretches) - STEP * (np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        b = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
        word, last = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], len(b) - 4
        at = checkpoints.copy()
        out = np.zeros((STEP, len(at)), self.kind)
        for k in range(min(STEP, int(left.max(initial=0)))):
            code = word[np.minimum(at >> 3, last)] >> (32 - LONGEST - (at & 7)) & ((1 << LONGEST) - 1)
            out[k] = self.id_at[code]
            at += self.bits_at[code]
        return out.T[np.arange(STEP)[None, :] < left[:, None]]


def _bounds(rows: DataFrame, key: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the rows with a key into about equal parts, and numbers of ids that cut those without one."""
    ways = [k / parts for k in range(1, parts)]
    cut = lambda df, c: np.array(sorted(set(df.approxQuantile(c, ways, 0.25 / parts))) if ways else [], np.float64)
    return cut(rows.where(F.col(key).isNotNull()), key), cut(rows.where(F.col(key).isNull()), "n_tokens")


def _slots(spark: SparkSession, n: int) -> list[int]:
    """Integers that Spark's hash partitioning deals to partitions 0..n-1 of n."""
    found: dict[int, int] = {}
    size = 8 * n
    while len(found) < n:
        for r in spark.range(size).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("i").alias("i")).collect():
            found[r["p"]] = r["i"]
        size *= 4
    return [found[p] for p in range(n)]


BLOCK = pa.schema([("first_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())),
                   ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])
BLOCK_SCHEMA = "first_id long, keys array<long>, n_tokens array<long>, bytes array<long>, checkpoints array<long>, bits binary"


def write(rows: DataFrame, path: str, key: str = "doc_id", wide: bool = False) -> None:
    """Write key (long), n_tokens and ids (16-bit little endian; 32-bit if wide) as a file set under path in ascending key
    order, nulls first. Repeated keys and null keys are kept, ordered by length and content. The driver holds the code (an
    entry per id of the vocabulary) and a number per key range, FINER times as many as there are shuffle partitions. Documents
    are coded before the shuffle, which moves bits only; tasks get about equal numbers of ids, one task a partition."""
    spark = rows.sparkSession
    counts = id_counts(rows, wide=wide).toPandas()
    ids, lengths = counts["id"].to_numpy(np.int64), code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(*x, wide) for x in zip(ids.tolist(), lengths.tolist())], "id int, length int, wide boolean").coalesce(1).write.parquet(f"{path}/code")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts, null_cuts = _bounds(rows, key, FINER * tasks)

    def range_of(keys: pa.Array, n: pa.Array) -> np.ndarray:
        """Number of the key range, in the order of the file set."""
        found = len(null_cuts) + 1 + np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        none = keys.is_null().to_numpy(zero_copy_only=False)
        found[none] = np.searchsorted(null_cuts, n.to_numpy(zero_copy_only=False)[none], side="right")
        return found

    def ranges(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(*b.columns).astype(np.int32)), b.column(1)], names=["range", "n_tokens"])

    totals = np.zeros(len(cuts) + len(null_cuts) + 2, np.int64)
    for r in rows.select(key, "n_tokens").mapInArrow(ranges, "range int, n_tokens long").groupBy("range").agg(F.sum("n_tokens").alias("n")).collect():
        totals[r["range"]] = r["n"]
    before = np.cumsum(totals) - totals
    group = np.minimum((2 * before + totals) * tasks // max(1, 2 * int(totals.sum())), tasks - 1)   # Task of a range, by its middle
    slots = _slots(spark, tasks)
    place = np.array(slots, np.int64)[group]
    starts = {slots[g]: int(before[group == g][0]) for g in set(group.tolist())}

    def pack(batches):
        code, kind = canonical(ids.tobytes(), lengths.tobytes(), wide), id_type(wide)
        for b in batches:
            n, at = b.column(1).to_numpy(), 0
            while at < len(n):   # As many documents as hold CALL_IDS ids together, one at least
                part = b.slice(at, max(1, int(np.searchsorted(np.cumsum(n[at:]), CALL_IDS, side="right"))))
                coded = code.encode(np.frombuffer(b"".join(part.column(2).to_pylist()), kind), n[at:at + len(part)])
                at += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(place[range_of(*part.columns[:2])].astype(np.int32)), *part.columns[:2], pa.array([x for x, _ in coded], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in coded], pa.binary())],
                                                 names=["part", key, "n_tokens", "bits", "points"])

    def blocks(batches):
        part, start, docs, held = None, 0, [], 0

        def flush():
            sizes = [len(x[2]) for x in docs]
            offsets = 8 * (np.cumsum(sizes) - sizes)
            points = np.concatenate([np.frombuffer(x[3], "<u4") + o for x, o in zip(docs, offsets)])
            row = {"first_id": start, "keys": [x[0] for x in docs], "n_tokens": [x[1] for x in docs], "bytes": sizes, "checkpoints": points.astype(np.int64), "bits": b"".join(x[2] for x in docs)}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for b in batches:
            for p, k, n, bits, points in zip(*(c.to_pylist() for c in b.columns)):
                if docs and (p != part or held + n > BLOCK_IDS):
                    yield flush()
                    start, docs, held = start + held, [], 0
                if p != part:
                    part, start = p, starts[p]
                docs.append((k, n, bits, points))
                held += n
        if docs:
            yield flush()

    coded = rows.select(key, "n_tokens", "ids").mapInArrow(pack, f"part int, `{key}` long, n_tokens long, bits binary, points binary")
    ordered = coded.repartition(tasks, "part").sortWithinPartitions("part", key, "n_tokens", "bits")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


@lru_cache(maxsize=2)
def canonical(ids: bytes, lengths: bytes, wide: bool) -> Code:
    return Code(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64), wide)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Every document of a file set: key, start (ids of all documents before it), n_tokens, ids (as they were written)."""
    book = spark.read.parquet(f"{path}/code").toPandas()
    ids, lengths, wide = book["id"].to_numpy(np.int64).tobytes(), book["length"].to_numpy(np.int64).tobytes(), bool(book["wide"].any())

    def run(batches):
        code = canonical(ids, lengths, wide)
        for b in batches:
            for row in b.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                flat = code.decode(row["bits"], n, np.array(row["checkpoints"], np.int64))
                ends = np.cumsum(n)
                out = [flat[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(row["first_id"] + ends - n), pa.array(n), pa.array(out, pa.binary())], names=[key, "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def checksums(rows: DataFrame, key: str = "doc_id", wide: bool = False) -> DataFrame:
    """key, start, n_tokens and the unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    kind = id_type(wide)

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_py(), kind).astype("<u4").tobytes()) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return rows.select(key, "start", "n_tokens", "ids").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")

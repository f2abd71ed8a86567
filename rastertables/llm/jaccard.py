"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered rare first by a sketch of counts over the whole corpus. A set of n shingles that shares enough with
another must share at least m of its first n - ceil(t n) + m shingles, for every m (Wang, Li, Feng 2012). Each document
picks its own m: a longer prefix costs more index entries, but fewer candidates reach m matches; the sketch estimates both.
Two documents are candidates when they share min(m, m') prefix shingles.

Shingles of few documents give candidate pairs; a shingle of many documents ties its documents to itself instead of pairing
them up. What hangs together by candidates is a family. Ties are loose: phrases that the sketch took for rare can chain up texts
that have little in common, and the more so the larger the corpus. Families whose blocks would need very many copies of their
sets are therefore sought again among their members, with the shingles that tied them now last in the order, as long as
that takes them apart (any order of the shingles finds all links). Each family's sets are then brought together once, in
blocks of bounded size, and compared exactly. Links form components. Documents with equal sets are one node throughout."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components, local_roots

WORDS, PERCENT = 4, 85
SKETCH_BITS, CHUNK_BITS, SLICE_BYTES = 20, 14, 1 << 20
MOST_MATCHES, VERIFY_COST = 8, 8
#: Other documents expected under a shingle whose cell is not above the mean: the sketch cannot tell one from a few.
UNSEEN = 0.5
LIGHT, BLOCK, HOT_COUNT, SALTS, BROADCAST_ROWS = 24, 256, 100_000, 64, 500_000
#: Shingles known to tie families (8 MB) and names of the sets looked at again (32 MB) that are broadcast at most. Beyond the
#: first, those of most sets are taken; beyond the second, all sets are looked at.
DEMOTED, WANTED = 1 << 20, 1 << 22
#: Large families are sought again while their blocks need more than so many copies per set of the whole corpus, and while
#: the last time left less than this share of their sets in large ones.
COPIES, APART = 1, 0.9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[_WHITE] = 0
_FACTOR = _DRAW.integers(0, 1 << 63, 1 << 6, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWER = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWER[0]) < n:
        _POWER[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _FACTOR[0])]), dtype=np.uint64)
    return _POWER[0]


def _slices(texts: pa.Array):
    """(first row, offsets, bytes) of runs of rows of some SLICE_BYTES, one row at least."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1)
        yield row, off[row:end + 1] - off[row], data[off[row]:off[end]]
        row = end


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for _, off, data in _slices(texts):
        white = _WHITE[data]
        start = ~white
        start[1:] &= white[:-1]
        inner = off[1:-1][off[1:-1] < len(data)]
        start[inner] = ~white[inner]
        starts = np.nonzero(start)[0]
        if not len(starts):
            yield from (np.empty(0, np.uint64) for _ in range(len(off) - 1))
            continue
        data, begin = data[starts[0]:], starts - starts[0]
        lengths = np.diff(np.append(begin, len(data)))
        within = np.arange(len(data)) - np.repeat(begin, lengths)
        h = _mix(np.add.reduceat(_BYTE[_LOWER[data]] * _powers(int(lengths.max()) + 1)[within], begin))
        first = np.searchsorted(starts, off)
        n = len(h)
        grams = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            grams += h[k:n - words + 1 + k] * _FACTOR[1 + k]
        grams = _mix(grams)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            if z - a >= words:
                yield np.unique(grams[a:z - words + 1])
            elif z > a:   # Fewer words than a shingle has: the whole sequence is one
                yield _mix((h[a:z] * _FACTOR[32:32 + z - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(z - a))
            else:
                yield np.empty(0, np.uint64)


def _profile(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """One pass over the texts: a row per document (size and 128-bit name of its set) and, per task, its sketch in chunks."""
    chunk = 1 << CHUNK_BITS

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = [key, "n_shingles", "s1", "s2", "chunk", "salt", "counts"]
        for b in batches:
            n, s = [], []
            for u in shingle_sets(b.column(1), words):
                n.append(len(u))
                s.append(xxhash.xxh3_128_digest(u.tobytes()))
                sketch += np.bincount((u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)) if len(u) > 50_000 else 0
                if len(u) <= 50_000:
                    np.add.at(sketch, (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            ids = np.frombuffer(b"".join(s), "<i8").reshape(-1, 2)
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), none, none, pa.nulls(len(n), pa.binary())], names=names)
        if sketch.any():
            salt = int(xxhash.xxh3_64_intdigest(sketch.tobytes()) % 8)
            k = len(sketch) // chunk
            nothing = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, salt, np.int32)),
                                              pa.array([sketch[i * chunk:(i + 1) * chunk].astype("<i8").tobytes() for i in range(k)], pa.binary())], names=names)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, n_shingles long, s1 long, s2 long, chunk int, salt int, counts binary")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    def run(batches):
        total: dict = {}
        for b in batches:
            for c, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                total[c, s] = total.get((c, s), 0) + np.frombuffer(x.as_py(), "<i8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([s for _, s in total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "salt", "counts"])

    return rows.repartition(*by).mapInArrow(run, "chunk int, salt int, counts binary")


def sketch(profile: DataFrame) -> np.ndarray:
    """Shingle counts of the corpus in 2^SKETCH_BITS cells (8 MB at any corpus size), summed in two levels."""
    rows = profile.where("chunk IS NOT NULL").select("chunk", "salt", "counts")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in _summed(_summed(rows, "chunk", "salt").withColumn("salt", F.lit(0)), "chunk").collect():
        total[r.chunk << CHUNK_BITS:(r.chunk + 1) << CHUNK_BITS] += np.frombuffer(r.counts, "<i8")
    return total


def rarity(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Rarity class of every cell, and the count that class 0 stands for. A full cell holds some mean + f of which f is the
    shingle's own, so classes grow with what lies above the cells' common noise, not with the noise."""
    mean = float(counts.mean())
    floor = max(0.0, mean - 2 * mean ** 0.5)
    return np.minimum(254, np.round(4 * np.log2(1.0 + np.maximum(0, counts - floor)))).astype(np.uint8), floor


def least_overlap(n, percent: int = PERCENT):
    return (percent * n + 99) // 100


def _among(u: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of u are in the sorted array names."""
    if not len(names):
        return np.zeros(len(u), bool)
    return names[np.minimum(np.searchsorted(names, u), len(names) - 1)] == u


def prefix(u: np.ndarray, classes: np.ndarray, over: np.ndarray, percent: int = PERCENT, last: np.ndarray = np.empty(0, np.uint64)) -> tuple[np.ndarray, int, np.ndarray]:
    """Prefix shingles, rare first, the number of matches they stand for, and their estimated counts. classes and over are
    the sketch's rarity class and the expected number of other documents, by cell. The shingles in last (sorted) are known to
    be of more than LIGHT documents and come after all others."""
    n = len(u)
    cell = (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    known = _among(u, last)
    rank = np.where(known, np.uint64(255), classes[cell].astype(np.uint64)) << np.uint64(56) | (u & np.uint64((1 << 56) - 1))
    over = np.where(known, np.maximum(over[cell], LIGHT), over[cell])
    p = n - least_overlap(n, percent) + 1
    longest = min(n, p + MOST_MATCHES - 1)
    at = np.argpartition(rank, longest - 1)[:longest] if longest < n else np.arange(n)
    at = at[np.argsort(rank[at], kind="stable")]
    others = np.cumsum(over[at])
    lengths = np.arange(p, longest + 1)
    m = np.arange(1, len(lengths) + 1)
    cost = lengths + others[lengths - 1] * (1 + VERIFY_COST / m)
    best = int(np.argmin(cost))
    at = at[:lengths[best]]
    return u[at], best + 1, over[at]


def _index(docs: DataFrame, key: str, text: str, counts: np.ndarray, percent: int, words: int = WORDS, hot_count: int = HOT_COUNT,
           last: np.ndarray = np.empty(0, np.uint64), wanted: np.ndarray | None = None) -> DataFrame:
    """Index entries: token, salt, s1, size, need. Equal sets of a task are entered once. Tokens above hot_count are dealt over
    the salts 1 to SALTS, and salt 0 is for all others: an entry under a hot token is known by its salt alone. last: see
    prefix; wanted: the sorted names s1 of the sets to enter (None: all)."""
    spark = docs.sparkSession
    classes, floor = rarity(counts)
    shared = spark.sparkContext.broadcast((classes, floor - float(counts.mean()), last, wanted))
    least = next(n for n in range(1, 1000) if (n + 1) * percent <= 100 * n) if percent < 100 else 1 << 60

    def run(batches):
        classes, above, last, wanted = shared.value
        over = np.maximum(UNSEEN, np.exp2(classes / 4.0) - 1 + above)
        seen: set[int] = set()
        for b in batches:
            tokens, size, need, names, spread = [], [], [], [], []
            for u in shingle_sets(b.column(0), words):
                if len(u) < least:   # Below this size only equal sets link
                    continue
                s1 = int(np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), "<i8")[0])
                if s1 in seen:
                    continue
                seen.add(s1)
                if wanted is not None and not _among(np.array([s1]), wanted)[0]:
                    continue
                t, m, c = prefix(u, classes, over, percent, last)
                tokens.append(t)
                size.append(np.full(len(t), len(u), np.int32))
                need.append(np.full(len(t), m, np.int8))
                names.append(np.full(len(t), s1, np.int64))
                spread.append(np.where(c > hot_count, 1 + s1 % SALTS, 0).astype(np.int8))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(spread)), pa.array(np.concatenate(names)), pa.array(np.concatenate(size)), pa.array(np.concatenate(need))],
                                                 names=["token", "salt", "s1", "size", "need"])

    return docs.select(text).mapInArrow(run, "token long, salt tinyint, s1 long, size int, need tinyint")


def _candidates(index: DataFrame, percent: int, light: int = LIGHT) -> DataFrame:
    """v, u, need: pairs of set names that share a light token, a row per token, or a set name and its heavy token."""
    def pairs(s1, size, need):
        i, j = np.triu_indices(len(s1), 1)
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        return np.maximum(s1[i], s1[j]), np.minimum(s1[i], s1[j]), np.minimum(need[i], need[j])

    def batch(v, u, n):
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(n.astype(np.int8))], names=["v", "u", "need"])

    def run(batches):
        held = None   # The last token's entries, until it ends or turns out heavy
        heavy = None
        for b in batches:
            token, salt, s1, size, need = (c.to_numpy() for c in b.columns)
            if held is not None:
                token, salt, s1, size, need = (np.concatenate([x, y]) for x, y in zip(held, (token, salt, s1, size, need)))
            fresh = np.ones(len(token), bool)   # Sorted: the same set under the same token stands side by side
            fresh[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (s1[1:] != s1[:-1])
            token, salt, s1, size, need = (x[fresh] for x in (token, salt, s1, size, need))
            first = np.nonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))[0]
            count = np.diff(np.append(first, len(token)))
            out_v, out_u, out_n = [], [], []
            is_heavy = (count > light) | (salt[first] != 0)
            if heavy is not None and (token[0], salt[0]) == heavy:
                is_heavy[0] = True
            rows = np.repeat(is_heavy, count)
            out_v.append(s1[rows]); out_u.append(token[rows]); out_n.append(np.zeros(int(rows.sum()), np.int8))
            last = len(first) - 1
            heavy = (token[first[last]], salt[first[last]]) if is_heavy[last] else None
            for f, c in zip(first[(count > 1) & ~is_heavy].tolist(), count[(count > 1) & ~is_heavy].tolist()):
                if f == first[last]:
                    continue
                v, u, n = pairs(s1[f:f + c], size[f:f + c], need[f:f + c])
                out_v.append(v); out_u.append(u); out_n.append(n)
            f = first[last]
            held = tuple(x[f if heavy is None else -1:].copy() for x in (token, salt, s1, size, need))
            yield batch(np.concatenate(out_v), np.concatenate(out_u), np.concatenate(out_n))
        if held is not None and heavy is None and len(held[0]) > 1:
            yield batch(*pairs(*held[2:]))

    return index.repartition("token", "salt").sortWithinPartitions("token", "salt", "s1").mapInArrow(run, "v long, u long, need tinyint")


def compare(sets: list[np.ndarray], block: np.ndarray, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least linked position and number of linked documents (copies counted) of every set of a block, or of a pair of blocks
    (then only pairs across are counted). Overlaps are products of 0/1 matrices over the shingles that occur twice."""
    k, n = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), n)
    shared = count[at] > 1
    at, row = np.unique(at[shared], return_inverse=True)[1], row[shared]
    width, inter = 4096, np.zeros((k, k), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, z = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((k, width), np.float32)
        m[row[a:z], at[a:z] - lo] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(linked, False)
    if block[0] != block[-1]:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(linked)
    root = np.arange(k)
    if len(i):
        nodes, roots = local_roots(i, j)
        root[nodes] = roots
    return root, linked @ copies


def _verify(families: DataFrame, docs: DataFrame, key: str, text: str, percent: int, words: int = WORDS) -> DataFrame:
    """families: rep, family, copies, blocks, block. Returns rep, root, links: what each rep is linked to, block by block."""
    def with_sets(batches):
        for b in batches:
            sets = [u.tobytes() for u in shingle_sets(b.column(5), words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sets, pa.binary())], names=["rep", "family", "copies", "blocks", "block", "shingles"])

    small = families.select("rep").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("_text"))
    joined = texts.join(F.broadcast(families) if small else families, "rep")
    sets = joined.select("rep", "family", "copies", "blocks", "block", "_text").mapInArrow(with_sets, "rep long, family long, copies long, blocks int, block int, shingles binary")
    spread = sets.select("rep", "family", "copies", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o"))
    spread = spread.select("family", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"), "block", "rep", "copies", "shingles")

    def run(batches):
        held, of = [], None

        def done():
            group = {r: (b, r, c, s) for b, r, c, s in held}   # A repeated document key counts once
            rows = sorted(group.values())
            if len(rows) < 2 or of[1] != of[2] and rows[0][0] == rows[-1][0]:
                return None
            rep, copies = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
            root, links = compare([np.frombuffer(x[3], np.uint64) for x in rows], np.array([x[0] for x in rows]), copies, percent)
            has = links > 0
            return pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(rep[root[has]]), pa.array(links[has])], names=["rep", "root", "links"])

        for b in batches:
            family, lo, hi, *rest = (c.to_pylist() for c in b.columns)
            for f, l, h, *row in zip(family, lo, hi, *rest):
                if (f, l, h) != of:
                    if held and (out := done()) is not None:
                        yield out
                    held, of = [], (f, l, h)
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return spread.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").mapInArrow(run, "rep long, root long, links long")


def _numbers(column: DataFrame, most: int) -> np.ndarray | None:
    """The sorted distinct longs of a one-column table, or None if there are more than most."""
    found = column.distinct().limit(most + 1).toArrow().column(0).to_numpy()
    return None if len(found) > most else np.sort(found)


def _tied(pairs: DataFrame) -> DataFrame:
    """node and root of every set that hangs together with another by candidates."""
    shared = pairs.where("need > 0").groupBy("v", "u").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("v", "u")
    tied = components(shared.unionAll(pairs.where("need = 0").select("v", "u")))
    return tied.unionAll(tied.select(F.col("root").alias("node"), "root").distinct())


def _sized(member: DataFrame) -> DataFrame:
    """member with _n, the number of sets of the family, without those alone in theirs. Counted per salt first: a family may
    hold any number."""
    salted = member.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(32)).cast("int"))
    sizes = salted.groupBy("family", "_salt").agg(F.count("*").alias("_n")).groupBy("family").agg(F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts"))
    return salted.join(sizes.where("_n > 1").select("family", "_n", F.explode("_salts").alias("_salt")), ["family", "_salt"]).drop("_salt")


def _families(sets: DataFrame, docs: DataFrame, key: str, text: str, counts: np.ndarray, percent: int, words: int, hot_count: int, light: int, block: int) -> DataFrame:
    """rep, copies, family and _n (sets of the family) of the sets that may have links; linked sets are in one family."""
    large = sets.select("rep", "copies", F.col("s1").alias("node"), F.lit(0).cast("long").alias("family"))
    done, asked, before, last, wanted = [], docs, None, np.empty(0, np.uint64), None
    most = COPIES * sets.count()
    while True:
        pairs = materialize(_candidates(_index(asked, key, text, counts, percent, words, hot_count, last, wanted), percent, light))
        # Sets that were apart stay apart. Two families of one hash would only be compared for nothing
        member = materialize(_sized(large.join(_tied(pairs), "node").select("rep", "copies", "node", F.xxhash64("family", "root").alias("family"))))
        done.append(member.where(F.col("_n") <= block))
        large = member.where(F.col("_n") > block)
        n, copies = large.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("_n") / block)), F.lit(0))).first()
        if copies <= most or before is not None and n > APART * before:
            return reduce(DataFrame.unionAll, [*done, large])
        ties = pairs.where("need = 0").groupBy("u").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "u").limit(DEMOTED).select("u")
        last = np.union1d(last, ties.toArrow().column(0).to_numpy().view(np.uint64))
        reps = large.select(F.col("rep").alias("_rep"))
        asked = docs.join(F.broadcast(reps), F.col(key).cast("long") == F.col("_rep"), "left_semi") if n <= BROADCAST_ROWS else docs
        wanted, before = _numbers(large.select("node"), WANTED), n


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, hot_count: int = HOT_COUNT,
         light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id and n_links (other documents whose sets of shingles of `words` words overlap by percent at
    least, copies counted) of every row.

    Null and blank texts have no shingles and no links. Rows with a null key are left as they are (component null). Rows
    that repeat a key count as one document each in n_links. hot_count and light only decide how candidates are found: shingles
    above hot_count are dealt over salts, those of more than light sets tie them to themselves instead of pairing them, and
    families of more than block sets are sought again and compared in blocks."""
    profile = materialize(_profile(docs, key, text, words))
    rows = profile.where("chunk IS NULL").select(key, "n_shingles", "s1", "s2")
    named = rows.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0)).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(32)).cast("int"))
    parts = named.groupBy("s1", "s2", "salt").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    sets = materialize(parts.groupBy("s1", "s2").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"), F.collect_list("salt").alias("salts")))
    member = _families(sets, docs.where(F.col(key).isNotNull()), key, text, sketch(profile), percent, words, hot_count, light, block)
    member = member.withColumn("blocks", F.ceil(F.col("_n") / block).cast("int"))
    families = materialize(member.select("rep", "family", "copies", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")))
    links = materialize(_verify(families, docs, key, text, percent, words))
    joined = components(links.select(F.col("rep").alias("v"), F.col("root").alias("u")))
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    whole = (sets.join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
             .select("s1", "s2", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.explode("salts").alias("salt")))
    out = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(32)).cast("int")).join(whole, ["s1", "s2", "salt"], "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

"""Exact Jaccard similarity join over word shingles, by token-combination prefixes.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one node (its signature). A sketch of fixed size
   counts all shingles and tells frequent ones from rare ones; rare ones that more than ALL_PAIRS prefixes turn out to
   hold are frequent, too (any division is right; this one keeps keys small).
2. Tokens are ordered rare first. Two sets that link share k tokens at least among the first n - ceil(t n) + k of each,
   with k = 2 + n / ONE_MORE. Where these are all rare in one of the sets, the two share k rare tokens, which are keys.
   Otherwise both prefixes hold all rare tokens and reach frequent ones, so the prefix is extended to the whole set: two
   such sets share a rare token, or differ in few enough frequent ones to agree in one of the combinations that
   ``combination_keys`` makes of them, about five tokens each, whatever the size of the set.
3. Up to ALL_PAIRS sets of a rare key are paired with each other. In all other keys, sets are paired with the key's
   centre, the set with fewest rare tokens. The links found are closed; a key whose sets are then in one component is
   done. In the others, the sets outside the key's largest component are joined with the sets of that and of other
   components, under bounds from sizes and from parity bitmaps of the whole sets, so that nothing that links is dropped
   and a group of near copies never yields its pairs.
4. Candidates are verified on their whole sets; components come from alternating stars of minima.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, lookup_join, table, trimmed, written

#: The sketch: counters, and in how many parts they are summed.
COUNTERS, PARTS = 1 << 20, 64
#: Most bits of the filters of heavy tokens and of texts that are candidates (a filter's errors only cost work).
FILTER_BITS = 1 << 25
#: Sets of one rare key that are all paired.
ALL_PAIRS = 16
#: For so many shingles more, two sets must share one more key (their prefixes are longer by as much).
ONE_MORE = 32
#: Longs of the parity bitmap of a set of WIDE shingles or more, and of smaller ones.
BITMAP, NARROW, WIDE = 32, 8, 300
#: Sets of a key that meet in one task at most; signatures that a task remembers.
CHUNK, REMEMBERED = 4096, 200_000
#: Bytes hashed at once.
_AT_ONCE = 1 << 18

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


#: Odd numbers that keep apart the places of a word's parts and words of different lengths.
_PLACE, _LENGTH = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15)
#: The bytes of a part that count if it has 0 to 8 of them.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-cased bytes; a word's hash doesn't depend on where it stands.

    A word's eight-byte parts enter one after the other, each followed by a bijective mixing of all 64 bits, so that, other than with
    powers of a number modulo 2**64, no family of words collides; any two do with a chance of 2**-64. Words of more than
    _LONG bytes are few, and get a BLAKE2 hash."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    out = _mix(size.astype(np.uint64) * _LENGTH)
    parts = np.ndarray((len(raw) + 1,), "<u8", data + bytes(16), 0, (1,))  # the eight bytes from each byte on
    left = np.flatnonzero(size <= _LONG)
    done = 0
    while len(left):
        part = parts[starts[left] + done] & _KEPT[np.minimum(size[left] - done, 8)]
        out[left] = _mix((out[left] ^ part) + np.uint64(_PLACE * (done + 1) % (1 << 64)))
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out, starts


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text: of fewer than ``width`` words, one for the whole sequence; none without words."""
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1) for i in range(width)]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < _AT_ONCE):
            size += len(texts[end] or b"") + 1
            end += 1
        part = [x or b"" for x in texts[at:end]]
        words, starts = word_hashes(b"\n".join(part).lower())
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in part)]))
        many = max(0, len(words) - width + 1)
        rolled = np.zeros(many, np.uint64)
        for i, by in enumerate(odd):
            rolled += words[i : i + many] * by
        rolled = _mix(rolled)
        for a, z in zip(cuts, cuts[1:]):
            if z - a >= width:
                yield np.unique(rolled[a : z - width + 1])
            elif z > a:
                yield _mix(np.array([(words[a:z] * np.array(odd[: z - a])).sum(dtype=np.uint64) + np.uint64(z - a)]))
            else:
                yield np.empty(0, np.uint64)
        at = end


def signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _named(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns], names.split())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text").cast(pa.binary()).to_pylist()


def _described(width: int):
    """Number of shingles and signature of every text; at the end the partition's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = "doc_id row n sig part chunk counts"
        none = lambda n, kind: pa.nulls(n, kind)
        for b in _slices(batches):
            sets = [*shingle_sets(_texts(b), width)]
            counts += np.bincount(np.concatenate([*sets, np.empty(0, np.uint64)]) % np.uint64(COUNTERS), minlength=COUNTERS).astype(np.uint32)
            yield _named(names, b.column("doc_id"), b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64()), none(len(sets), pa.int64()), none(len(sets), pa.int32()), none(len(sets), pa.binary()))
        n = TaskContext.get().partitionId()
        if counts.any():
            parts = counts.reshape(PARTS, -1)
            yield _named(names, *[none(PARTS, pa.int64())] * 4, pa.array([n] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()))

    return trimmed(run)


def _combined(parts: DataFrame, either: bool) -> dict[int, bytes]:
    """For each chunk of ``part, chunk, counts`` the sum of all partitions' counters (first 32, then 64 bits), or the bits
    that either has: in rounds of 64 partitions at most, so that no task gets more."""

    def add(key, rows):
        found = rows.column("counts").to_pylist()
        if either:
            total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in found])
        else:
            total = np.sum([np.frombuffer(x, np.uint64 if len(x) == 8 * COUNTERS // PARTS else np.uint32).astype(np.uint64) for x in found], axis=0, dtype=np.uint64)
        return pa.table({"part": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    left = parts.agg(F.max("part")).collect()[0][0]
    if left is None:
        return {}
    while True:
        parts = parts.withColumn("part", F.shiftright("part", 6)).groupBy("part", "chunk").applyInArrow(add, "part long, chunk int, counts binary")
        left //= 64
        if left == 0:
            return {r["chunk"]: r["counts"] for r in parts.collect()}


def _summed(sketches: DataFrame) -> np.ndarray:
    found = _combined(sketches, False)
    return np.concatenate([np.frombuffer(found[i], np.uint64) for i in range(PARTS)]) if found else np.zeros(COUNTERS, np.uint64)


def _bits_of(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = _mix(ids.view(np.uint64))
    return [(mixed >> np.uint64(s)) % np.uint64(bits) for s in (0, 29)]


def _in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _bits_of(ids, 8 * len(bits)):
        out &= (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter, as packed bits (sixteen for each id, FILTER_BITS at most), of the one column of ``ids``, a stored table."""
    size = min(FILTER_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            for at in _bits_of(b.column(0).to_numpy(), size):
                bits[at] = True
        n = TaskContext.get().partitionId()
        if bits.any():
            yield _named("part chunk counts", pa.array([n] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([np.packbits(x).tobytes() for x in bits.reshape(PARTS, -1)], pa.binary()))

    found = _combined(written(ids.mapInArrow(trimmed(run), "part long, chunk int, counts binary")), True)
    return np.concatenate([np.frombuffer(found[i], np.uint8) for i in range(PARTS)]) if found else np.zeros(size // 8, np.uint8)


def token_classes(counts: np.ndarray) -> np.ndarray:
    """1 for counters that show more than chance, which hold the frequent tokens; else 0."""
    mean = counts.mean()
    return (counts > max(16.0, mean + 8 * mean**0.5)).astype(np.uint8)


def _more(n):
    return 1 + n // ONE_MORE


def _prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1 + _more(n)


def _most_apart(both, percent: int):
    """Tokens that are in one of two linked sets only, at most; ``both``: the sum of their sizes."""
    return (100 - percent) * both // (100 + percent)


#: Where classes of sizes begin: each is half as large again as the one before.
SIZES = [1, 2]
while SIZES[-1] < 1 << 40:
    SIZES.append(max(SIZES[-1] + 1, SIZES[-1] * 3 // 2))


def combination_keys(often: np.ndarray, n: int, rare: int, percent: int) -> list[np.ndarray]:
    """Keys of a set of ``n`` tokens by its frequent ones, ``often``: of two sets that link without a rare token in
    common, at least one key is equal.

    Sizes fall into classes; a set has keys for its own class and for those above that it can link with, and two sets
    meet in the class of the larger. There, tokens are dealt to buckets, and a bucket's tokens are one combination. Sets
    that link differ in ``apart`` tokens at most, so with apart + 1 + spare buckets they agree in 1 + spare or more. A
    set needs fewer keys by the tokens that it can't have in common: its rare ones, and those by which it is smaller than
    its class (the last buckets are left out, so at least 1 + spare of those that both sets have still agree). Empty
    buckets are no key, unless a set has more than ``spare`` of them.
    """
    out, dealt, c = [], _mix(often), bisect.bisect_right(SIZES, n) - 1
    while percent * SIZES[c] <= 100 * n:
        upper = SIZES[c + 1] - 1
        most, apart = _most_apart(2 * upper, percent), _most_apart(n + min(upper, 100 * n // percent), percent)
        if apart >= max(1, rare):
            spare = 2 + (most + 1) // 8
            buckets, own = most + 1 + spare, apart + 1 + spare - rare
            at = (dealt % np.uint64(buckets)).astype(np.int64)
            total = np.zeros(buckets, np.uint64)
            np.add.at(total, at, often)
            use = np.flatnonzero(np.bincount(at, minlength=buckets)[:own])
            if own - len(use) > spare:
                use = np.arange(own)
            out.append(_mix(total[use] + _mix(use.astype(np.uint64) + np.uint64(c << 40))))
        c += 1
    return out


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of the parity of the tokens in each of many buckets: two sets, both of WIDE tokens or more or both smaller,
    differ in at least as many tokens as their bitmaps in bits."""
    many = 64 * (BITMAP if len(tokens) >= WIDE else NARROW)
    at = (_mix(tokens) >> np.uint64(40)) % np.uint64(many)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64)


def _fresh_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Signature and tokens of the sets of more than one token (one links with itself only, and that is the same set),
    for each slice of a partition; sets among the last REMEMBERED ones are left out."""
    seen: set[int] = set()
    for b in _slices(batches):
        out = []
        for s in shingle_sets(_texts(b), width):
            if len(s) > 1 and (sig := signature(s)) not in seen:
                seen.add(sig)
                out.append((sig, s))
        if len(seen) > REMEMBERED:
            seen.clear()
        yield out


def _rare_keys(width: int, percent: int, classes):
    """``key``: the rare tokens in the prefix of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.value
        for sets in _fresh_sets(batches, width):
            if sets:
                yield _named("key", pa.array(np.concatenate([s[of[s % np.uint64(COUNTERS)] == 0][: _prefix_length(len(s), percent)] for _, s in sets]).view(np.int64)))

    return trimmed(run)


_SET = "key sig n rare frequent " + " ".join(f"b{i}" for i in range(BITMAP))


def _prefix_keys(width: int, percent: int, classes, heavy):
    """Rows of ``key`` of each set, and one without a key that has its bitmap. ``heavy``: a filter of tokens that are frequent, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bits = classes.value, heavy.value
        for sets in _fresh_sets(batches, width):
            keys: list[np.ndarray] = []
            single, size, described, maps = [], [], [], []
            for sig, s in sets:
                n = len(s)
                often = of[s % np.uint64(COUNTERS)] > 0
                often |= _in_filter(bits, s.view(np.int64))
                few = s[~often]
                first = few[: _prefix_length(n, percent)]
                more = combination_keys(s[often], n, len(few), percent) if len(first) == len(few) else []
                keys += [first, *more]
                single.append(len(first))
                size.append(len(first) + sum(map(len, more)))
                described.append((sig, n, len(few)))
                maps.append(parity_bitmap(s))
            if not sets:
                continue
            of_key = [np.repeat(np.array(x, np.int64), size) for x in zip(*described)]
            frequent = np.concatenate([np.arange(z) >= a for a, z in zip(single, size)])
            none = pa.nulls(len(frequent), pa.int64())
            yield _named(_SET, pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, of_key), pa.array(frequent), *[none] * BITMAP)
            sets_of = [pa.array(x, pa.int64()) for x in zip(*described)]
            yield _named(_SET, pa.nulls(len(sets), pa.int64()), *sets_of, pa.nulls(len(sets), pa.bool_()), *map(pa.array, np.stack(maps).T.copy()))

    return trimmed(run)


_PAIR, _PAIRS = "a b need star key", "a long, b long, need long, star boolean, key long"


def _pair_rows(sig, n, rare, a, b, percent: int, star) -> pa.RecordBatch:
    """``need``: in how many rare keys the two must meet to be candidates.

    1 + _more(n), unless both prefixes end in frequent tokens. Then these may be shared instead; but all rare tokens
    of both are keys, so a set's unshared ones are known, and with fewer shared than ``least`` the union is too large.
    """
    near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    a, b, star = a[near], b[near], star[near]
    need = 1 + _more(np.minimum(n[a], n[b]))
    mixed = rare < _prefix_length(n, percent)
    least = -((-percent * (n[a] + n[b])) // (100 + percent)) - np.minimum(n[a] - rare[a], n[b] - rare[b])
    need = np.where(mixed[a] & mixed[b], np.minimum(need, np.maximum(1, least)), need)
    return _named(_PAIR, pa.array(np.minimum(sig[a], sig[b])), pa.array(np.maximum(sig[a], sig[b])), pa.array(need), pa.array(star), pa.nulls(len(a), pa.int64()))


def _rare_pairs(percent: int):
    """From ``key sig n rare`` sorted by key, rare and sig: pairs of up to ALL_PAIRS sets of a key; of more, pairs with the
    first, its centre, and a row with the key for each. No more than ALL_PAIRS rows of a key are held at once."""

    def large(cols: list[np.ndarray], centre: list) -> Iterator[pa.RecordBatch]:
        key, sig, n, rare = cols
        yield _named(_PAIR, pa.array(sig), *[pa.nulls(len(sig), pa.int64())] * 2, pa.nulls(len(sig), pa.bool_()), pa.array(key))
        sig, n, rare = (np.r_[c, x] for c, x in zip(centre[1:], (sig, n, rare)))
        other = np.flatnonzero(sig != sig[0])
        yield _pair_rows(sig, n, rare, np.zeros(len(other), np.int64), other, percent, np.ones(len(other), bool))

    def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fresh = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
        key, sig, n, rare = (x[fresh] for x in cols)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]):
            i, j = np.triu_indices(r, 1)
            a.append((first[size == r][:, None] + i).ravel())
            b.append((first[size == r][:, None] + j).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield _pair_rows(sig, n, rare, a, b, percent, np.zeros(len(a), bool))
        for start, r in zip(first[size > ALL_PAIRS], size[size > ALL_PAIRS]):
            run = [x[start : start + r] for x in (key, sig, n, rare)]
            yield from large(run, [x[0] for x in run])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = centre = None
        for b in batches:
            cols = [b.column(x).to_numpy() for x in ("key", "sig", "n", "rare")]
            if not len(cols[0]):
                continue
            if centre is not None:
                same = int(np.searchsorted(cols[0], centre[0], "right"))
                if same:
                    yield from large([x[:same] for x in cols], centre)
                    cols = [x[same:] for x in cols]
                if not len(cols[0]):
                    continue
                centre = None
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            full = int(np.searchsorted(cols[0], cols[0][-1]))
            if full:
                yield from whole([x[:full] for x in cols])
            rest = [x[full:] for x in cols]
            if len(rest[0]) > ALL_PAIRS:
                centre = [x[0] for x in rest]
                yield from large(rest, centre)
                rest = None
        if rest is not None:
            yield from whole(rest)

    return trimmed(run)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return trimmed(run)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges(a, b)``: the smallest node reachable. Alternating large and small stars;
    hot centres are looked up by broadcast, so that no node's edges meet in one task."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = edges.count()
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")).withColumn("m", F.least("u", "m")))
        large = written(lookup_join(both.where("v > u"), least, "u", "w", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")))
        small = lookup_join(large, down, "u", "w", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return written(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")))


def _across(met: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of sets of different components that may link.

    ``met``: for each key in which such sets meet, rows of ``top`` (the key's largest component), ``frequent`` and ``sig``.
    Of two such sets one at least is outside ``top``. So all sets of the keys that a component tops are one group, however
    many keys they share, and in a group the sets outside the component are joined with all others, CHUNK at a time.
    Bounds let pass what may link only: sizes; bits by which the bitmaps differ; and of sets that meet in frequent keys
    and need share no rare token, the frequent tokens of each."""
    rows = written(met.distinct())
    chunks = rows.groupBy("top", "frequent").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    sets = written(rows.join(chunks, ["top", "frequent"]).join(known, "sig"))
    x = sets.where("label <> top").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("x")
    y = sets.withColumn("chunk", F.pmod(F.xxhash64("sig"), "chunks").cast("int")).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(BITMAP)), F.lit(0))
    few = F.lit(100 + percent) * F.least(n - F.col("x.rare"), m - F.col("y.rare")) >= F.lit(percent) * (n + m)
    once = (F.col("y.label") == F.col("y.top")) | (F.col("x.sig") < F.col("y.sig"))
    may = (F.col("x.label") != F.col("y.label")) & once & (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (((n >= WIDE) != (m >= WIDE)) | (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (n + m))) & (~F.col("x.frequent") | few)
    both = x.join(y, (F.col("x.top") == F.col("y.top")) & (F.col("x.frequent") == F.col("y.frequent")) & (F.col("x.chunk") == F.col("y.chunk")) & may)
    return both.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, n, sig, component_id, kept`` for every row of ``docs``. row: a hash of its text; sig: its set, null if
    empty; kept: the set of the row with the smallest id of the component."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = written(rows.withColumn("row", F.xxhash64("text")).mapInArrow(_described(width), "doc_id long, row long, n long, sig long, part long, chunk int, counts binary"))
    meta = out.where("chunk is null").select("doc_id", "row", "n", "sig")
    shared = docs.sparkSession.sparkContext.broadcast
    classes = shared(token_classes(_summed(out.where("chunk is not null").select("part", "chunk", "counts"))))
    nodes = written(meta.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))

    texts = rows.where("doc_id is not null").select("text")
    # what the sketch can't tell from chance: tokens that many prefixes hold are frequent from here on
    heavy = written(texts.mapInArrow(_rare_keys(width, percent, classes), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > ALL_PAIRS).select("key"))
    heavy = shared(id_filter(heavy))
    bits = [f"b{i}" for i in range(BITMAP)]
    keys = written(texts.mapInArrow(_prefix_keys(width, percent, classes, heavy), "key long, sig long, n long, rare long, frequent boolean, " + ", ".join(f"{x} long" for x in bits)))
    found = written(keys.where("not frequent").select("key", "sig", "n", "rare").repartition("key").sortWithinPartitions("key", "rare", "sig").mapInArrow(_rare_pairs(percent), _PAIRS))
    hot = keys.where("frequent").select("key", "sig", "n", "rare")
    centres = written(hot.groupBy("key").agg(F.min(F.struct("rare", "sig", "n")).alias("c"), F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count(F.lit(1)).alias("w")).where("lo <> hi").select("key", F.col("c.sig").alias("centre"), F.col("c.n").alias("cn"), F.col("c.rare").alias("cr"), "w"))
    at_hot = written(lookup_join(hot, centres, "key", "w", hot.count()).where("centre is not null"))
    far = (F.lit(100) * F.least("n", "cn") < F.lit(percent) * F.greatest("n", "cn")) | (F.lit(100 + percent) * F.least(F.col("n") - F.col("rare"), F.col("cn") - F.col("cr")) < F.lit(percent) * (F.col("n") + F.col("cn")))
    stars = at_hot.where((F.col("sig") != F.col("centre")) & ~far).select(F.least("sig", "centre").alias("a"), F.greatest("sig", "centre").alias("b"), F.lit(1).cast("long").alias("need"))
    # in how many keys two sets meet: exact where all sets of a key are paired, with centres only a hint
    pairs = written(found.where("b is not null").select("a", "b", "need").unionByName(stars).groupBy("a", "b").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("times")).where("times >= need").select("a", "b"))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = written(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count(F.lit(1)).alias("w")))
        known = whole_sets(wanted)
        hot = written(wanted.where(F.col("w") > max(1000, pairs.count() // HOT_SHARE)).select("sig"))

        def attach(left: DataFrame, key: str, name: str) -> DataFrame:
            """The set of the node in ``key``: of hot nodes (HOT_SHARE at most) by broadcast, of others by a shuffle."""
            of = known.select(F.col("sig").alias(key), F.col("tokens").alias(name))
            hot_key = F.broadcast(hot.select(F.col("sig").alias(key)))
            return left.join(F.broadcast(of.join(hot_key, key).dropDuplicates([key])), key).unionByName(left.join(hot_key, key, "left_anti").join(of, key))

        both = attach(attach(pairs, "a", "set_a"), "b", "set_b")
        return written(both.mapInArrow(_verified(percent), "a long, b long").distinct())

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """``sig, tokens`` of the nodes ``wanted(sig)`` (and of a few others, by chance of the filter), hashed again from their texts."""
        of = shared(id_filter(written(nodes.join(wanted.select("sig"), "sig", "left_semi").select("rep"))))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                near = _in_filter(of.value, b.column("doc_id").to_numpy())
                found = [s for s in shingle_sets(_texts(b.filter(pa.array(near))), width) if len(s)]
                yield _named("sig tokens", pa.array([signature(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()))

        return written(rows.where("doc_id is not null").mapInArrow(trimmed(sets), "sig long, tokens binary"))

    links = verify(pairs)
    labels = components(links)
    known = written(keys.where("key is null").drop("key", "frequent").dropDuplicates(["sig"]).join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    large = found.where("b is null").select("key", F.col("a").alias("sig"), F.lit(False).alias("frequent")).unionByName(at_hot.select("key", "sig", F.lit(True).alias("frequent")))
    split = written(large.join(known.select("sig", "label"), "sig").distinct())
    by_label = split.groupBy("key", "label").agg(F.count(F.lit(1)).alias("w"))
    mixed = written(by_label.groupBy("key").agg(F.sum("w").alias("w"), F.max(F.struct("w", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "w", F.col("top.label").alias("top")))
    met = lookup_join(split.drop("label"), mixed, "key", "w", split.count()).where("top is not null").select("top", "frequent", "sig")
    more = written(_across(met, known, percent).join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        labels = components(written(links.unionByName(verify(more))))

    joined = written(nodes.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    smallest = joined.groupBy("label").agg(F.min(F.struct("rep", "sig")).alias("first"), F.count(F.lit(1)).alias("w")).select("label", F.col("first.rep").alias("component_id"), F.col("first.sig").alias("kept"), "w")
    of_sig = written(lookup_join(joined.select("sig", "copies", "label"), smallest, "label", "w", joined.count()).select("sig", "component_id", "kept", "copies"))
    done = lookup_join(meta, of_sig, "sig", "copies", meta.count())
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", "row", "n", "sig", own.alias("component_id"), "kept")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two rows link when 100 * intersection >= percent * union of their sets of ``width``-word shingles (fewer words: the
    whole sequence; none: an empty set, which links with nothing). component_id: the smallest id reachable by links,
    its own included; null for a null id, which links with nothing. Repeated rows are in one component. Texts of any
    length are taken whole; an empty table gives an empty result; other columns of ``docs``, whatever their names, play
    no part.
    """
    return _classes(docs, width, percent, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, of which one stays of each component: that with the smallest id.

    What decides is the row, not its id: if rows of one id have texts of different components, each component keeps one.
    Of rows with equal id and text one stays (any, if other columns differ); rows without words link with nothing and
    stay, as do all rows without an id. An empty table stays empty; columns may have any names.
    """
    found = _classes(docs, width, percent, id_col, text_col).where("doc_id is not null")
    first = found.where("sig is null or (doc_id = component_id and sig = kept)")
    # of one id and one set, texts may still differ in blanks and case
    kept = first.where("sig is not null").groupBy("doc_id", "sig").agg(F.min("row").alias("row")).unionByName(first.where("sig is null").select("doc_id", "sig", "row")).select("doc_id", "row").distinct()
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole"))
    once = whole.where("doc_id is not null").join(kept, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return once.select("whole.*").unionByName(docs.where(F.col(id_col).isNull()))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at 4-word shingles and a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x AS doc_id, y AS other FROM s UNION SELECT r.doc_id, s.y FROM r JOIN s ON r.other = s.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id) m USING (doc_id)
"""

QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES = {"op10_ngram_jaccard": ORACLE}

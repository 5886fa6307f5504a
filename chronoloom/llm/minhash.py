"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. A narrow pass turns each text into its set of word shingles and keeps the set's
   size, a digest, one key per band of ``ROWS`` min-hashes, and one byte of each
   min-hash.
2. Equal sets are one vertex, named by their smallest document. Members of a
   bucket are paired with the bucket's smallest member only.
3. A pair's signature bytes are compared batch by batch; it goes as soon as the
   posterior chance (uniform prior) that its similarity reaches the threshold is
   under ``MISS``. Survivors are verified on the full sets of their texts.
4. Components of the links are found. Where a bucket still holds several
   components, the members of all but its largest one are compared with all members
   of other components, by signatures and then on full sets, so that a link between
   two members that are both far from the smallest one isn't lost. Such buckets are
   read in blocks, and one link between two components is all that leaves a block.

A pair at the threshold shares no bucket with a chance of under 5e-7. Buckets with
the same members count once. Edges are one per member and made distinct before
texts are fetched, and joins may be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches, materialize
from chronoloom.llm.graph import connected_components

ROWS, BANDS, BATCH = 6, 48, 32
#: Chance of dropping a pair that reaches the threshold, at each comparison.
MISS = 1e-7
#: Words whose hashes one Python worker remembers.
CACHE_WORDS = 50_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_KEYS = _RNG.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at blank, tab, line feed, vertical tab, form
    feed and carriage return."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence, if it
    has fewer words than a shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = _mix(out * _ODD + h[j : j + n])
    return np.unique(out)


def min_hashes(found: np.ndarray, block: int = 2048) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), block):
        x = h[k : k + block, None] * _A
        x += _B
        np.minimum(best, x.min(0), out=best)
    return best


def features(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_shingles, digest, bands, signature)``; the last three are null
    for an empty set."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, hashes = [], [], []
            for x in batch.column(1).cast(pa.large_binary()):
                found = shingles(words_of(x.as_py()), width)
                sizes.append(len(found))
                if len(found):
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    hashes.append(min_hashes(found))
                else:
                    digests.append(None)
            sig = np.array(hashes, np.uint32).reshape(-1, BANDS, ROWS)
            keys = _mix((sig.astype(np.uint64) * _KEYS).sum(2) + np.arange(BANDS, dtype=np.uint64) * _ODD).view(np.int64)
            bytes_, bands, signatures = sig.astype(np.uint8).reshape(-1, BANDS * ROWS), iter(keys.tolist()), []
            rows = iter(bytes_)
            signatures = [next(rows).tobytes() if d else None for d in digests]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([next(bands) if d else None for d in digests], pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.transform(map_batches, run, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary")


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared bytes, how many must agree. With a uniform prior
    the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail at t is
    the chance of at most m successes in n + 1 trials of chance t. Unequal
    min-hashes agree in their byte once in 256."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


#: Ids that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles of a bucket's members that are compared in one block, about.
BLOCK_SHINGLES = 1_000_000


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids`` (one column of its name,
    written already); counted first, and broadcast if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), "ends")


def plausible(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` that no comparison of signature batches rules out."""
    least = np.array(least_matches(threshold))
    some = only(signatures, "v", ends(pairs))
    sides = [some.select(F.col("v").alias(c), F.col("signature").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    near = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for i in (2, 3))
            alive, agree = np.arange(len(x)), np.zeros(len(x), int)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                agree = agree + (x[alive, part] == y[alive, part]).sum(1)
                stay = agree >= need
                alive, agree = alive[stay], agree[stay]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return near.transform(map_batches, run, "a long, b long")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(v, shingles)``: each text's sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(x.as_py()), width).tobytes() for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["v", "shingles"])

    return texts.select("v", "text").transform(map_batches, run, "v long, shingles binary")


def links_across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` between components within a bucket, at least one for each two
    components that have any there; from ``(key, size, v, c, signature, shingles)``,
    where ``size`` is the number of shingles in the bucket.

    Large buckets are dealt into chunks by a hash, and each two chunks meet in a
    block of their own, so memory is bounded. A member outside of the block's
    largest component is compared with all members of other components: signature
    batches first, then intersections of the full sets, counted for all at once.
    """
    threshold = num / den
    least = np.array(least_matches(threshold))
    chunks = F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int")
    chunk = F.pmod(F.xxhash64("v"), chunks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), chunks - 1), lambda k: F.struct(F.least(k, "chunk").alias("i"), F.greatest(k, "chunk").alias("j")))
    dealt = members.withColumn("chunk", chunk).withColumn("meets", meets).select("key", F.explode("meets").alias("m"), "v", "c", "signature", "shingles")
    dealt = dealt.select("key", "m.i", "m.j", "v", "c", "signature", "shingles")

    def compare(v, c, sig, sets) -> list[tuple[int, int]]:
        _, of = np.unique(c, return_inverse=True)
        largest = np.bincount(of).argmax()
        n = np.array([len(s) for s in sets])
        out = []
        for i in np.flatnonzero(of != largest):
            other = (of != of[i]) & ((of == largest) | (np.arange(len(v)) > i)) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
            alive = np.flatnonzero(other)
            agree = np.zeros(len(alive), int)
            for k, need in enumerate(least):
                if not len(alive):
                    break
                part = slice(k * BATCH, (k + 1) * BATCH)
                agree = agree + (sig[alive, part] == sig[i, part]).sum(1)
                stay = agree >= need
                alive, agree = alive[stay], agree[stay]
            if not len(alive):
                continue
            mine, theirs = sets[i], np.concatenate([sets[k] for k in alive])
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[alive]) - n[alive])
            linked = alive[den * common >= num * (n[i] + n[alive] - common)]
            if len(linked):
                _, first = np.unique(of[linked], return_index=True)
                out += [(min(int(v[i]), int(v[k])), max(int(v[i]), int(v[k]))) for k in linked[first]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            found = set()
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if tuple(place[x]) != now:
                    found.update(compare(*_gather(held)) if held else ())
                    held, now = [], tuple(place[x])
                held.append([batch.column(k).slice(x, y - x) for k in range(3, 7)])
            yield _pairs(found)
        if held:
            yield _pairs(set(compare(*_gather(held))))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").transform(map_batches, run, "a long, b long").distinct()


def _gather(held: list) -> tuple:
    v, c = (np.concatenate([h[k].to_numpy() for h in held]) for k in range(2))
    sig = np.frombuffer(b"".join(x for h in held for x in h[2].to_pylist()), np.uint8).reshape(-1, ROWS * BANDS)
    return v, c, sig, [np.frombuffer(x, np.uint64) for h in held for x in h[3].to_pylist()]


def _pairs(found) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar(x: list[bytes], y: list[bytes], width: int, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union of the two sets, on the words
    themselves: shingles are numbered, not hashed."""
    numbers: dict = {}
    sides = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in (x, y)]
    codes = []
    for side in sides:
        w = min(width, len(side))
        codes.append([side[j : j + len(side) - w + 1] for j in range(w)])
    if len(codes[0]) != len(codes[1]):  # one is shorter than a shingle: equal lengths or nothing in common
        return False
    n = len(codes[0][0])
    code = np.zeros(n + len(codes[1][0]), np.int64)
    for p, q in zip(*codes, strict=True):
        _, code = np.unique(code * len(numbers) + np.concatenate([p, q]), return_inverse=True)
    a, b = np.unique(code[:n]), np.unique(code[n:])
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts' full sets are similar enough. Only texts of
    vertices in a pair are fetched; a pair's two texts meet by joins on the vertex, never in a group."""
    some = materialize(only(texts, "v", ends(pairs)), "texts")
    met = pairs.join(some.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b").join(some.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, words = [], None, []
            for a, ta, tb in zip(batch.column(0), batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary()), strict=True):
                if a.as_py() != last:
                    last, words = a.as_py(), words_of(ta.as_py())
                ok.append(similar(words, words_of(tb.as_py()), width, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.transform(map_batches, run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row.

    Documents are linked if den * |intersection| >= num * |union| of their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable and
    ``kept`` says that it is the row's own. Null text counts as empty; a text
    without words has an empty set and is linked with nothing. Rows with equal ids
    are one vertex with several sets, all of them kept if the id is its
    component's smallest; a row with a null id is linked with nothing, has a null
    component and is kept. An empty table gives no rows; further columns are
    ignored.
    """
    threshold = num / den
    feats = materialize(features(docs, width, id_col, text_col), "features")
    named = feats.where("doc_id is not null and digest is not null")
    # Written first, so that Spark can split the join at a set that very many documents share.
    first = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("v")), "first")
    member = materialize(named.select("doc_id", "digest").join(first, "digest").select("doc_id", "v"), "members")
    of = member.distinct()  # an id with several sets stands for each of their vertices
    signatures = feats.where("digest is not null").select(F.col("doc_id").alias("v"), "signature", "n_shingles")
    texts = docs.select(F.col(id_col).cast("long").alias("v"), F.col(text_col).cast("string").alias("text")).where("v is not null")

    banded = named.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("key")
    # Written first: a join of two exchanges is one that Spark can split at a hot key.
    inside = materialize(banded.join(materialize(shared, "shared"), "key").join(of, "doc_id").select("key", "v").distinct(), "inside")
    twins = inside.groupBy("key").agg(F.count("*").alias("size"), F.min("v").alias("a"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    buckets = twins.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key"), F.min("a").alias("a"))
    star = materialize(inside.join(buckets.select("key", "size", "a"), "key"), "stars")

    tested = materialize(star.where("v <> a").select("a", F.col("v").alias("b")).distinct(), "pairs")
    links = materialize(verify(materialize(plausible(tested, signatures, threshold), "plausible"), texts, width, num, den), "links")
    component = materialize(connected_components(links, "a", "b"), "components")

    c = component.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
    placed = star.join(c, "v", "left").withColumn("c", F.coalesce("c", "v"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p <> q").select("key")
    members = materialize(placed.join(mixed, "key", "left_semi").select("key", "v", "c"), "mixed")
    several = member.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a <> z")
    more = member.join(several, "doc_id").select("a", F.col("v").alias("b")).where("a <> b")
    if not members.isEmpty():
        ids = materialize(members.select("v").distinct(), "ends")
        sets = full_sets(only(texts, "v", ids), width)
        known = materialize(only(signatures, "v", ids).join(sets, "v"), "sets")
        size = members.join(known.select("v", "n_shingles"), "v").groupBy("key").agg(F.sum("n_shingles").alias("size"))
        across = links_across(members.join(size, "key").join(known.drop("n_shingles"), "v"), num, den)
        more = more.unionByName(verify(materialize(across, "across"), texts, width, num, den))
    more = materialize(more, "more")
    if not more.isEmpty():
        component = connected_components(component.select(F.col("component").alias("a"), F.col("vertex").alias("b")).unionByName(more), "a", "b")
    own = of.groupBy("doc_id").agg(F.min("v").alias("v"))
    found = own.join(component.withColumnRenamed("vertex", "v"), "v", "left").select("doc_id", F.coalesce("component", "v").alias("component"))
    return feats.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept")
    )

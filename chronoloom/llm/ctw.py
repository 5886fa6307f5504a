"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, and each of the 255 inner nodes of that binary
tree has a context tree of its own over the bytes before: depth 0 knows no
context, depth d the last d bytes. Every node of a context tree counts its zeros
and ones; its Krichevsky-Trofimov estimate is mixed half and half with the product of
its children's mixtures, so all depths take part, weighted by how well each
coded the training text. The code length of a text is the sum over its bits.

Spark gathers the counts of all sequences of ``depth + 1`` bytes. They grow with the
corpus and stay distributed:

1. Each task adds up its own and sends them packed, dealt by the hash of the last
   ``SHALLOW + 1`` bytes of context; a bucket is merged and written in runs of whole
   such contexts. Sequences that only held-out texts hold are there with a count of 0.
2. Going up, each run mixes the depths below ``SHALLOW``; the sums of logarithms for
   the nodes at depth ``SHALLOW`` (at most 256 ** SHALLOW * 255) are added by Spark, and
   the driver mixes the rest.
3. Going down, each run takes what the nodes at depth ``SHALLOW`` pass on and
   writes the log probability of each sequence.
4. The ``TOP`` most frequent sequences at most are broadcast as a hash table of fixed
   size; a text's others are looked up by a join. The first bytes of a text have NUL
   bytes before them.

Besides, :func:`score` gives the usual add-one unigram score. Its vocabulary is
unbounded, so word counts stay distributed: only the ``FREQUENT`` most frequent
words of limited length are broadcast, all others are looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches, materialize
from chronoloom.llm.minhash import words_of

#: Bytes of context unless told otherwise, and the most that a sequence's code of 48 bits can hold.
DEPTH, DEEPEST = 2, 5
#: Depths up to this one are mixed on the driver, all below in buckets.
SHALLOW, BUCKETS = 2, 1024
#: Sequences that a task holds at once, and those in one run of a bucket unless a context has more.
HELD, RUN = 1 << 20, 1 << 17
#: Sequences in the broadcast table at most, its slots (a power of two) and how far from its own slot one may stand.
TOP, SLOT_BITS, PROBES = 2_000_000, 22, 16
#: Words in the broadcast dictionary, and the longest of them in bytes.
FREQUENT, LONGEST = 200_000, 32
END = b"\n"  # stands for the end of a text among the words; no word holds a line feed


def _codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the ``depth`` before it, length of each text). The
    byte itself is the lowest of a code, the one before it the highest, so codes in
    order are contexts in the tree's order."""
    lengths = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * depth
    data = np.frombuffer(gap.join([b"", *texts]), np.uint8).astype(np.uint64)
    n = len(data) - depth
    code = data[depth:].copy()
    for back in range(1, depth + 1):
        code |= data[depth - back : depth - back + n] << np.uint64(8 * (depth + 1 - back))
    inside = np.ones(n, bool)  # but where the gap itself is the last byte
    ends = np.cumsum(lengths + depth)[:-1] - depth
    for k in range(depth):
        inside[ends + k] = False
    return code[inside], lengths


def _slices(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """Texts in runs of about ``most`` bytes; null counts as empty."""
    held, size = [], 0
    for x in column.cast(pa.large_binary()):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct codes, and the sums of the other columns for each."""
    code, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    return code[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _above(code: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Codes with ``to`` bytes of context from codes with ``depth``."""
    return ((code >> np.uint64(8 * (depth - to + 1))) << np.uint64(8)) | (code & np.uint64(255))


_RUNS = "bucket int, code binary, n binary, held binary"


def _run_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "code", "n", "held"])


def count_sequences(texts: DataFrame, depth: int) -> DataFrame:
    """Counts over a frame ``(held_out, text)``: rows ``(bucket, code, n, held)`` with
    packed columns, each a run of whole contexts of ``SHALLOW + 1`` bytes in order;
    ``n`` counts in training texts, ``held`` in the others."""
    whole = np.uint64(8 * max(depth - SHALLOW, 0))  # below it in a code: older bytes, and the byte itself

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush():
            code, n, held = _summed(parts)
            bucket = (((code >> whole) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)
            order = np.argsort(bucket, kind="stable")
            code, n, held, bucket = code[order], n[order], held[order], bucket[order]
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for k in range(0, len(edges) - 1, 64):
                yield _run_rows([(int(bucket[i]), _pack(code[i:j]), _pack(n[i:j]), _pack(held[i:j])) for i, j in zip(edges[k : k + 64], edges[k + 1 : k + 65], strict=False) if j > i])

        for batch in batches:
            for out in (False, True):
                for some in _slices(batch.column(1).filter(pc.equal(batch.column(0), out)), 1 << 20):
                    code, n = np.unique(_codes(some, depth)[0], return_counts=True)
                    none = np.zeros(len(n), np.uint64)
                    n = n.astype(np.uint64)
                    parts.append((code, none, n) if out else (code, n, none))
                    size += len(code)
            if size > 2 * HELD:
                parts = [_summed(parts)]
                size = len(parts[0][0])
                if size > HELD:
                    yield from flush()
                    parts, size = [], 0
        if parts:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, now = [], 0, None

        def flush():
            code, n, held = _summed(parts)
            new = np.flatnonzero((code[1:] >> whole) != (code[:-1] >> whole)) + 1  # where a run may end
            i = 0
            while i < len(code):
                at = np.searchsorted(new, i + RUN)
                j = int(new[at]) if at < len(new) else len(code)
                yield _run_rows([(now, _pack(code[i:j]), _pack(n[i:j]), _pack(held[i:j]))])
                i = j

        for batch in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and size >= RUN:  # small buckets share a run
                    yield from flush()
                    parts, size = [], 0
                now = bucket
                parts.append(tuple(map(_unpack, packed)))
                size += len(parts[-1][0])
                if size > HELD and size > 2 * len(parts[0][0]):
                    parts = [_summed(parts)]
                    size = len(parts[0][0])
        if parts:
            yield from flush()

    return texts.transform(map_batches, count, _RUNS).repartition("bucket").sortWithinPartitions("bucket").transform(map_batches, merge, _RUNS)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    out = np.zeros(a.shape)
    some = (a + b) > 0
    out[some] = _log_gamma(a[some] + 0.5) + _log_gamma(b[some] + 0.5) - _log_gamma(a[some] + b[some] + 1.0) - np.log(np.pi)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, by recurrence below."""
    x = x.astype(np.float64).copy()
    low = np.zeros_like(x)
    while (small := x < 8).any():
        low[small] += np.log(x[small])
        x[small] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - low


_HALF = np.log(0.5)


class _Rung:
    """The sequences of one depth: sorted codes, counts, and where each stands one depth above."""

    def __init__(self, code: np.ndarray, n: np.ndarray, up: np.ndarray | None = None):
        self.code, self.n, self.up = code, n, up

    def nodes(self, k: int) -> None:
        """The nodes at which bit ``k`` is decided: one for each context and the ``k`` bits before."""
        key = self.code >> np.uint64(8 - k)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.first, self.node = np.flatnonzero(new), np.cumsum(new) - 1
        bit = (self.code >> np.uint64(7 - k)) & np.uint64(1)
        ones, total = (np.add.reduceat(x, self.first).astype(np.float64) for x in (self.n * bit, self.n))
        self.kt, self.p = _log_kt(total - ones, ones), (ones + 0.5) / (total + 1.0)

    def names(self, k: int) -> np.ndarray:
        """Context and place in the tree of eight bits (1 is its root) of each node."""
        code = self.code[self.first]
        return ((code >> np.uint64(8)) << np.uint64(8) | ((code & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - k))).astype(np.int64)


def ladder(code: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[_Rung]:
    """Rungs of the depths ``depth`` down to ``least``."""
    rungs = [_Rung(code, n)]
    for d in range(depth, least, -1):
        above, up = np.unique(_above(rungs[-1].code, d, d - 1), return_inverse=True)
        order = np.argsort(up, kind="stable")
        first = np.searchsorted(up[order], np.arange(len(above)))
        rungs[-1].up = up
        rungs.append(_Rung(above, np.add.reduceat(rungs[-1].n[order], first)))
    return rungs


def climb(rungs: list[_Rung], k: int, below: np.ndarray | None) -> None:
    """Mixtures of bit ``k`` bottom up. ``below`` has the sums of the logarithms of the
    mixtures under the deepest nodes; without it these are the tree's leaves."""
    for r in rungs:
        r.nodes(k)
    for i, r in enumerate(rungs):
        r.mix = r.kt if below is None else np.logaddexp(_HALF + r.kt, _HALF + below)
        r.weight = np.ones(len(r.kt)) if below is None else np.exp(_HALF + r.kt - r.mix)
        if i + 1 < len(rungs):
            above = rungs[i + 1]
            below = np.bincount(above.node[r.up[r.first]], r.mix, len(above.first))


def descend(rungs: list[_Rung], so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top down: (probability of a one from the depths so far, weight that is left)
    at each of the deepest nodes, from those at the nodes above the rungs."""
    for i, r in reversed(list(enumerate(rungs))):
        if i + 1 < len(rungs):
            above = rungs[i + 1].node[r.up[r.first]]
            so_far, left = so_far[above], left[above]
        so_far, left = so_far + left * r.weight * r.p, left * (1 - r.weight)
    return so_far, left


def _gain(code: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """Log probability of bit ``k`` of each code, whose chance of being one is ``p``."""
    return np.log(np.where((code >> np.uint64(7 - k)) & np.uint64(1) == 1, p, 1 - p))


def log_probabilities(runs: DataFrame, depth: int) -> DataFrame:
    """``(code long, nats float, n long)``: the log probability of the byte at the end of
    each counted sequence, and how often texts of either kind hold it."""
    top = min(depth, SHALLOW)

    def columns(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for packed in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                yield map(_unpack, packed)

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n, _ in columns(batches):
            rungs = ladder(code, n, depth, top)
            *deep, last = rungs
            key, value, count = [last.code.astype(np.int64)], [np.zeros(len(last.code))], [last.n.astype(np.int64)]
            kind = [np.zeros(len(last.code), np.int32)]
            for k in range(8 if deep else 0):
                last.nodes(k)
                climb(deep, k, None)
                key.append(last.names(k))
                value.append(np.bincount(last.node[deep[-1].up[deep[-1].first]], deep[-1].mix, len(last.first)))
                count.append(np.zeros(len(last.first), np.int64))
                kind.append(np.ones(len(last.first), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kind, key, count, value)], ["kind", "key", "n", "below"])

    # At most 256 ** (SHALLOW + 1) sequences and 256 ** SHALLOW * 255 nodes.
    sums = runs.transform(map_batches, upward, "kind int, key long, n long, below double").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    sums = sums.toArrow()
    kind, key, n, below = (sums.column(c).to_numpy() for c in ("kind", "key", "n", "below"))
    order = np.argsort(key)
    some, nodes = order[kind[order] == 0], order[kind[order] == 1]
    names, passed = [], []
    if len(some):
        rungs = ladder(key[some].astype(np.uint64), n[some].astype(np.uint64), top, 0)
        for k in range(8):
            rungs[0].nodes(k)
            name = rungs[0].names(k)
            climb(rungs, k, below[nodes[np.searchsorted(key[nodes], name)]] if depth > top else None)
            names.append(name)
            passed.append(np.stack(descend(rungs, np.zeros(len(rungs[-1].first)), np.ones(len(rungs[-1].first)))))
    names, passed = np.concatenate(names or [np.zeros(0, np.int64)]), np.concatenate(passed or [np.zeros((2, 0))], 1)
    order = np.argsort(names)
    sent = runs.sparkSession.sparkContext.broadcast((names[order], passed[:, order]))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, passed = sent.value
        for code, n, held in columns(batches):
            *deep, last = ladder(code, n, depth, top)
            nats = np.zeros(len(code))
            for k in range(8):
                last.nodes(k)
                so_far, left = passed[:, np.searchsorted(names, last.names(k))]
                if deep:
                    climb(deep, k, None)
                    above = last.node[deep[-1].up[deep[-1].first]]
                    so_far, _ = descend(deep, so_far[above], left[above])
                nats += _gain(code, so_far[(deep[0] if deep else last).node], k)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(nats.astype(np.float32)), pa.array((n + held).astype(np.int64))], ["code", "nats", "n"])

    return runs.transform(map_batches, downward, "code long, nats float, n long")


class Table:
    """A hash table of codes: the slot and the 26 other bits of a bijective hash name
    a code, together with how far it stands from its own slot."""

    _EMPTY, _ALL = np.uint32(0xFFFFFFFF), np.uint64((1 << 48) - 1)

    def __init__(self, code: np.ndarray, nats: np.ndarray):
        self.mark, self.nats = np.full(1 << SLOT_BITS, self._EMPTY), np.zeros(1 << SLOT_BITS, np.float32)
        at, rest = self._home(code)
        wait = np.arange(len(code))
        for far in range(PROBES):  # what finds no slot is left to the join
            slot = (at[wait] + far) & ((1 << SLOT_BITS) - 1)
            free = self.mark[slot] == self._EMPTY
            one, which = np.unique(slot[free], return_index=True)
            put = wait[free][which]
            self.mark[one], self.nats[one] = rest[put] | np.uint32(far << (48 - SLOT_BITS)), nats[put]
            wait = np.setdiff1d(wait, put, assume_unique=True)

    @classmethod
    def _home(cls, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (code * np.uint64(0x9E3779B97F4B)) & cls._ALL
        h ^= h >> np.uint64(24)
        h = (h * np.uint64(0xC2B2AE3D27D5)) & cls._ALL
        return (h >> np.uint64(48 - SLOT_BITS)).astype(np.int64), (h & np.uint64((1 << (48 - SLOT_BITS)) - 1)).astype(np.uint32)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each code or 0, places of those that aren't here)."""
        at, rest = self._home(code)
        hit = self.mark[at] == rest
        nats = np.where(hit, self.nats[at], np.float32(0)).astype(np.float64)
        wait = np.flatnonzero(~hit)
        for far in range(1, PROBES):
            slot = (at[wait] + far) & ((1 << SLOT_BITS) - 1)
            mark = self.mark[slot]
            hit = mark == (rest[wait] | np.uint32(far << (48 - SLOT_BITS)))
            nats[wait[hit]] = self.nats[slot[hit]]
            wait = wait[~hit]
        return nats, wait


def count_words(texts: DataFrame) -> DataFrame:
    """``(word binary, n)`` over a frame with one column of text; each text has one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for x in batch.column(0).cast(pa.large_binary()):
                total.update(words_of(x.as_py()))
                total[END] += 1
                if len(total) > 400_000:
                    yield flush()
        if total:
            yield flush()

    return texts.transform(map_batches, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """Rows with so large an ``n`` that there are at most ``most`` of them. The bound on
    the count comes from a histogram of a few hundred rows, so nothing is sorted
    and no task sends more than the result."""
    level = F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int")
    rows, least = 0, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        rows += r["count"]
        if rows > most:
            break
        least = r["level"]
    return counted.where(level >= least) if least is not None else counted.where("false")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte)`` of each row's whole text.

    ``score`` is the context-tree model's log10 probability of the text's bytes,
    each after the ``depth`` before it (0 to ``DEEPEST``), and ``bits_per_byte`` its code length per byte (null for no bytes);
    ``base_score`` is the add-one unigram score of its words and its end. Both
    models learn from the rows for which ``held_out`` is false (a null counts as
    false). Null text counts as empty: one token, its end. Rows with equal or null
    ids are scored each. Without training rows the models are uniform. Further
    columns are ignored.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth must be from 0 to {DEEPEST}")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learn = src.where(~F.col("held_out")).select("text")
    runs = materialize(count_sequences(src.select("held_out", "text"), depth), "sequences")
    known = materialize(log_probabilities(runs, depth), "probabilities")
    often = _frequent(known, TOP).select("code", "nats").toArrow()
    table = spark.sparkContext.broadcast(Table(often.column("code").to_numpy().astype(np.uint64), often.column("nats").to_numpy()))
    vocabulary = materialize(count_words(learn), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = size["n"], size["v"]
    top = _frequent(vocabulary.where(F.octet_length("word") <= LONGEST), FREQUENT).toPandas()
    frequent = spark.sparkContext.broadcast(dict(zip(top["word"].map(bytes), np.log10(top["n"] + 1.0), strict=True)))
    scale = float(np.log10(total + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, known = table.value, frequent.value
        for batch in batches:
            sums, texts, far = [], [], []
            for held in _slices(batch.column(2), 1 << 20):
                code, lengths = _codes(held, depth)
                own, some, ends = np.zeros(len(held)), np.flatnonzero(lengths), np.cumsum(lengths)
                nats, missed = log_p.find(code)
                if len(some):
                    own[some] = np.add.reduceat(nats, (ends - lengths)[some])
                of, code = np.searchsorted(ends, missed, side="right") + len(texts), code[missed]
                order = np.lexsort((code, of))
                of, code = of[order], code[order]
                new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])])[: len(of)])
                far.append((of[new], code[new].astype(np.int64), np.diff(np.append(new, len(of)))))
                sums.append(own)
                texts += held
            of, code, times = (np.concatenate(x) for x in zip(*far, strict=True)) if far else (np.zeros(0, np.int64),) * 3
            far = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(code), pa.array(times, pa.int64())], ["code", "times"]))
            sums = np.concatenate(sums) if sums else np.zeros(0)
            tokens, base, rare_words, rare_counts, offsets, hits = [], [], [], [], [0], []
            for text in texts:
                words = words_of(text)
                tokens.append(len(words) + 1)
                values = list(map(known.get, words))
                values.append(known.get(END))
                rare = [w for w, v in zip(words, values) if v is None]
                if values[-1] is None:
                    rare.append(END)
                hits.append(len(values) - len(rare))
                base.append(float(sum(v for v in values if v is not None)) if rare else float(sum(values)))
                own = Counter(rare)
                rare_words += own
                rare_counts += own.values()
                offsets.append(len(rare_words))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base), pa.array(sums), pa.array([len(t) for t in texts], pa.int64()), rest, far],
                ["doc_id", "held_out", "n_tokens", "hits", "base", "nats", "n_bytes", "rest", "far"],
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    scored = materialize(src.transform(map_batches, run, f"doc_id {kind}, held_out boolean, n_tokens long, hits long, base double, nats double, n_bytes long, rest array<struct<word:binary,times:long>>, far array<struct<code:long,times:long>>").withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    words = rare.join(vocabulary, "word").select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.lit(0.0).alias("nats_far"))
    far = scored.select("row", F.explode("far").alias("r")).select("row", "r.code", "r.times")
    bytes_ = far.join(known.select("code", "nats"), "code").select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("times") * F.col("nats").cast("double")).alias("nats_far"))
    looked_up = words.unionByName(bytes_).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "gain", "nats_far")))
    filled = scored.drop("rest", "far").join(looked_up, "row", "left").withColumn("nats", F.col("nats") + F.coalesce("nats_far", F.lit(0.0)))
    return filled.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("nats") / F.lit(float(np.log(10)))).alias("score"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("nats") / F.lit(float(np.log(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )

"""Removal of long repeated substrings.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. Starts that can't repeat are ruled out first, without losing any:

1. Every window of ``length`` bytes is assigned to the one of its 64-byte grams
   with the smallest hash. Equal windows choose the same gram at the same offset,
   so windows only need comparing where a gram's hash occurs more than once. The
   windows that share a gram form one segment of the text.
2. Grams are counted by hash. Of each distinct segment of a gram that occurs more
   than once (distinct by a second hash), one copy is fetched, or two from different
   places if there are more: what repeats only in equal segments is found by the
   transform, too, on the bytes of two of them.
3. Segments are dealt by gram and joined into blocks. A block is read as
   eight-byte words on a grid through the gram, its suffix array and
   Burrows-Wheeler transform are built, and breadth-first backward extension finds
   the boundaries between suffixes by increasing common prefix: an interval of
   suffixes with a common prefix is extended to the left by each word that comes
   before, and the first time an interval ends at a place, that is where the common
   prefix is as long as the level. It stops at the number of whole words that any window holds;
   suffixes with no boundary between them share at least that. The up to eight
   bytes before and behind those words are then compared exactly.

Segments of one gram that exceed a block (a passage shared by millions of
different documents) are compared by 128-bit hashes of all their windows instead,
counted by Spark; the result is the same. Copies are collapsed before anything is
gathered, a document's own spans are the only lists that are collected, each span
once, and only texts that hold a repeat are shuffled, by document, never by passage
(all of them, where there are too many such texts for their keys to be broadcast).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import few, map_batches, materialize

GRAM, WORD = 64, 8
#: Bytes of segments that are compared in one block, and bytes of one gram's segments that go to a block at most.
BLOCK, HOT = 2 << 20, 24 << 20
#: Bytes of text whose grams are hashed at once.
SLICE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the 64 bytes from each position on, by doubling."""
    h = _mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _ODD)
    for k in (8, 16, 32):
        h = _mix(h[:-k] * _ODD + h[k:])
    return h


def anchors(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, gram position, gram hash, text number) of each run
    of windows that share a gram. ``starts`` has where each text of ``data`` begins,
    and the end; no window crosses texts."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none
    h, w = gram_hashes(data), length - GRAM + 1
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    grid = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[: len(key) - w + 1], ahead[w - 1 : len(key)])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(least)]
    p = np.flatnonzero(np.arange(len(least)) + length <= starts[1:][text])
    at, of = (least[p] & _LOW).astype(np.int64), text[p]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])[: len(p)])
    lo, hi = p[new], p[np.concatenate([new[1:] - 1, [len(p) - 1]])[: len(new)]]
    return lo, hi, at[new], h[at[new]], of[new]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, r, text): d and r name a row's id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text, F.col(id_col).isNull()).alias("r"), text.alias("text"))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """``(d, r, f, dg, lo, hi, at)``: the segments of each text; ``f`` is the gram's
    hash, ``dg`` a hash of the segment and the gram's place in it."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bases, parts in _parts(batch.column(2), length):
                data = b"".join(parts)
                starts = np.cumsum([0, *map(len, parts)])
                lo, hi, at, f, of = anchors(data, starts, length)
                dg = [xxhash.xxh3_64_intdigest(data[i : j + length], a - i) for i, j, a in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)]
                shift = (np.array(bases) - starts[:-1])[of]
                row = pa.array(np.array(rows)[of])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(f.view(np.int64)), pa.array(np.array(dg, np.uint64).view(np.int64)), *(pa.array(x + shift) for x in (lo, hi, at))],
                    ["d", "r", "f", "dg", "lo", "hi", "at"],
                )

    return keyed.transform(map_batches, run, "d long, r long, f long, dg long, lo long, hi long, at long")


def _parts(column: pa.Array, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in slices of about ``SLICE`` bytes; a longer text comes in parts that
    overlap by one byte less than a window, so each window is in one part."""
    rows, bases, parts, held = [], [], [], 0
    for i, x in enumerate(column):
        text = x.as_py()
        for base in range(0, len(text) - length + 1, SLICE):
            part = text[base : base + SLICE + length - 1]
            rows.append(i)
            bases.append(base)
            parts.append(part)
            held += len(part)
            if held >= SLICE:
                yield rows, bases, parts
                rows, bases, parts, held = [], [], [], 0
    if parts:
        yield rows, bases, parts


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) of an array of ranks by prefix doubling.
    All suffixes must differ, which different end marks see to."""
    _, rank = np.unique(text, return_inverse=True)
    n, k = len(text), 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        k *= 2
    return order, rank


def long_prefix_groups(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group of each): neighbours in a group share their first
    ``least`` symbols. By breadth-first backward extension."""
    order, rank = suffix_array(text)
    n = len(text)
    before = np.where(order > 0, text[order - 1], -1)  # the transform; nothing is before the first
    to = rank[order - 1]  # where the suffix one longer stands
    by = np.argsort(before, kind="stable")
    same = before[by][1:] == before[by][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by[:-1][same]] = by[1:][same]
    preceding[by[1:][same]] = by[:-1][same]
    extends = before >= 0

    edge = np.zeros(n + 1, bool)  # a boundary before this place
    edge[0] = edge[n] = True
    lb, rb = np.array([0]), np.array([n - 1])
    for level in range(least):
        if not len(lb):
            break
        size = rb - lb + 1
        of = np.repeat(np.arange(len(lb)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lb[of]
        ok = extends[at]
        last = ok & (following[at] > rb[of])
        ends = at[last]
        new = ~edge[to[ends] + 1]
        if level == 0:
            new[:] = True
        ends, end_of = ends[new], of[last][new]
        first = ok & (preceding[at] < lb[of])
        begins, begin_of = at[first], of[first]
        width = int(before.max()) + 2
        begin_key = begin_of * width + before[begins]
        put = np.argsort(begin_key)
        match = put[np.searchsorted(begin_key, end_of * width + before[ends], sorter=put)]
        lb, rb = to[begins[match]], to[ends]
        edge[rb + 1] = True
    group = np.cumsum(edge[:-1])
    return order, group


def repeated_starts(segments: list[bytes], offsets: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows (by start) also start elsewhere in
    these segments. ``offsets`` has where each segment's gram stands in it."""
    least = (length - WORD + 1) // WORD
    words, place, owner, left = [], [], [], []
    for i, (s, off) in enumerate(zip(segments, offsets, strict=True)):
        skip = off % WORD
        n = (len(s) - skip) // WORD
        words.append(np.frombuffer(s, ">u8", n, skip).astype(np.uint64))
        place.append(skip + WORD * np.arange(n + 1))
        owner.append(np.full(n + 1, i))
        left.append(b"\0" * WORD + s + b"\0" * (2 * WORD))
    distinct, number = np.unique(np.concatenate(words), return_inverse=True)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    parts = np.split(number + len(segments), cuts)
    text = np.concatenate([np.append(w, i) for i, w in enumerate(parts)])  # each with an end mark of its own
    place, owner = np.concatenate(place), np.concatenate(owner)
    order, group = long_prefix_groups(text, least)
    sizes = np.bincount(group)
    many = sizes[group] > 1
    at, group = order[many], group[many]
    lengths = np.array([len(s) for s in segments])
    at_place, at_owner = place[at], owner[at]
    ok = at_place + WORD * least <= lengths[at_owner]
    at_place, at_owner, group = at_place[ok], at_owner[ok], group[ok]
    found = [np.zeros(max(0, len(s) - length + 1), bool) for s in segments]
    if not len(group):
        return found
    # The bytes around the words: those before as one number, those behind as one or two.
    pool, base = b"".join(left), np.cumsum([0, *(len(x) for x in left)])[:-1]
    at_pool = base[at_owner] + at_place
    raw = np.frombuffer(pool, np.uint8)
    load = np.ndarray((len(pool) - 7,), ">u8", pool, strides=(1,))
    before = load[at_pool].astype(np.uint64)  # ends where the words begin
    behind_at = at_pool + WORD + WORD * least
    rest = length - WORD * least  # bytes of a window outside its words: 8 to 15
    behind = np.stack([raw[behind_at + k] for k in range(rest)], 1) if rest > WORD else None
    ahead = load[behind_at].astype(np.uint64)
    flat_base = np.cumsum([0, *map(len, found)])
    flat = np.zeros(flat_base[-1], bool)
    for x in range(WORD):  # windows that begin x bytes before the words
        start = at_place - x
        fit = (start >= 0) & (start + length <= lengths[at_owner])
        if not fit.any():
            continue
        a = before[fit] & np.uint64((1 << (8 * x)) - 1)
        tail = rest - x
        if tail <= WORD:
            b = ahead[fit] >> np.uint64(8 * (WORD - tail)) if tail else np.zeros(fit.sum(), np.uint64)
            columns = (b, a, group[fit])
        else:
            columns = (*(behind[fit, k] for k in range(WORD, tail)), ahead[fit], a, group[fit])
        put = np.lexsort(columns)
        eq = np.ones(len(put) - 1, bool)
        for c in columns:
            c = c[put]
            eq &= c[1:] == c[:-1]
        twin = np.concatenate([eq, [False]]) | np.concatenate([[False], eq])
        flat[(flat_base[at_owner[fit]] + start[fit])[put[twin]]] = True
    return [flat[i:j] for i, j in zip(flat_base, flat_base[1:], strict=False)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_in(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word: what stands between blanks; a character of a script
    that doesn't part words (Han, kana, Thai and its neighbours) is a word of its own."""
    b = np.frombuffer(text, np.uint8)
    after = np.append(b[1:], 0)[: len(b)]
    three = ((b >= 0xE3) & (b <= 0xE9)) | ((b == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((b == 0xE1) & ((after <= 0x82) | (after == 0x9E) | (after == 0x9F))) | ((b == 0xEF) & (after >= 0xA4) & (after <= 0xAB))
    four = (b == 0xF0) & (after >= 0xA0)
    alone = three | four
    inside = alone.copy()
    for k in (1, 2):
        inside[k:] |= alone[:-k] if len(b) > k else False
    inside[3:] |= four[:-3] if len(b) > 3 else False
    plain = ~_BLANK[b] & ~inside
    first, last = _runs(plain)
    at = np.flatnonzero(alone)
    start, end = np.append(first, at), np.append(last + 1, at + np.where(four[at], 4, 3))
    order = np.argsort(start)
    return start[order], end[order]


def has_short_words(docs: DataFrame, words: int, below: int, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text some ``words`` words in a row have fewer bytes than ``below``."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for x in batch.column(place).cast(pa.large_binary()):
                start, end = words_in(x.as_py() or b"")
                some.append(len(start) >= words and bool((end[words - 1 :] - start[: len(start) - words + 1] < below).any()))
            yield batch.filter(pa.array(some, pa.bool_()))

    return docs.transform(map_batches, run, docs.schema)


_SPANS = "array<struct<s:long,e:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _compare(segments: DataFrame, length: int) -> DataFrame:
    """``(f, dg, spans)`` from ``(f, dg, off, seg)``, in blocks sorted by gram; of two
    copies of a segment the first is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            masks = repeated_starts([x[3] for x in held], [x[2] for x in held], length)
            rows, told = [], None
            for (f, dg, _, _), mask in zip(held, masks, strict=True):
                if mask.any() and (f, dg) != told:
                    rows.append((f, dg, [{"s": s, "e": e} for s, e in zip(*map(np.ndarray.tolist, _runs(mask)), strict=True)]))
                told = f, dg
            held.clear()
            f, dg, spans = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(dg, pa.int64()), pa.array(spans, _SPAN_TYPE)], ["f", "dg", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != last:
                    yield flush()
                    size = 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield flush()

    return segments.repartition("f").sortWithinPartitions("f", "dg").transform(map_batches, run, f"f long, dg long, spans {_SPANS}")


def _compare_hot(segments: DataFrame, length: int) -> DataFrame:
    """The same for grams with more segments than a block holds: all windows by hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, dg, _, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = [xxhash.xxh3_128_intdigest(seg[p : p + length]) for p in range(len(seg) - length + 1)]
                hashes = np.array([(x >> 64, x & (2**64 - 1)) for x in h], np.uint64).view(np.int64).reshape(-1, 2)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(pa.array([x] * k, pa.int64()) for x in (f, dg)), pa.array(range(k), pa.int64())], ["h1", "h2", "f", "dg", "s"])

    windows = segments.transform(map_batches, run, "h1 long, h2 long, f long, dg long, s long")
    often = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return windows.join(often, ["h1", "h2"], "left_semi").select("f", "dg", "s").distinct().groupBy("f", "dg").agg(F.collect_list(F.struct("s", F.col("s").alias("e"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(d, r, starts)``: for each text with any, the runs of starts of repeated windows."""
    keyed = _keyed(docs, id_col, text_col)
    rows = materialize(_anchor_rows(keyed.where(F.octet_length("text") >= length), length), "anchors")
    shared = rows.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    # Written first: a join of two exchanges is one that Spark can split at a hot gram.
    occ = materialize(rows.join(materialize(shared, "shared"), "f"), "occurrences")

    place = F.struct("d", "r", "lo", "hi", "at")
    one = occ.groupBy("f", "dg").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y"))
    one = materialize(one.select("f", "dg", F.explode(F.when(F.col("n") > 1, F.array("x", "y")).otherwise(F.array("x"))).alias("x")).select("f", "dg", "x.*"), "segments")
    heavy = materialize(one.groupBy("f").agg(F.sum(F.col("hi") - F.col("lo") + length).alias("size")).where(F.col("size") > hot).select("f", F.lit(True).alias("heavy")), "heavy")
    wanted = one.join(F.broadcast(heavy) if few(heavy) else heavy, "f", "left").groupBy("d", "r").agg(F.collect_list(F.struct("f", "dg", "heavy", "lo", "hi", "at")).alias("want"))
    wanted = materialize(wanted, "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                out += [(w["f"], w["dg"], w["at"] - w["lo"], text[w["lo"] : w["hi"] + length], bool(w["heavy"])) for w in want.as_py()]
            columns = zip(*out, strict=True) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["f", "dg", "off", "seg", "heavy"])

    # Repeated rows are one text here: two places may be the same one in two of them.
    texts = _met(keyed, wanted).dropDuplicates(["d", "r"])
    cuts = texts.join(wanted, ["d", "r"]).select("text", "want").transform(map_batches, cut, "f long, dg long, off long, seg binary, heavy boolean")
    if heavy.isEmpty():
        spans = _compare(cuts.drop("heavy"), length)
    else:
        cuts = materialize(cuts, "cuts")
        spans = _compare(cuts.where("not heavy").drop("heavy"), length).unionByName(_compare_hot(cuts.where("heavy").drop("heavy"), length))
    spans = materialize(spans, "spans")
    starts = occ.join(spans, ["f", "dg"]).select("d", "r", "lo", F.explode("spans").alias("x")).select("d", "r", (F.col("lo") + F.col("x.s")).alias("s"), (F.col("lo") + F.col("x.e")).alias("e"))
    return starts.distinct().groupBy("d", "r").agg(F.collect_list(F.struct("s", "e")).alias("starts"))


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (d, r) is in ``keys``, as far as these can be broadcast."""
    keys = keys.select("d", "r")
    return rows.join(F.broadcast(keys), ["d", "r"], "left_semi") if few(keys) else rows


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), hot: int = HOT, words: int = 0) -> DataFrame:
    """``(doc_id, *keep, n_bytes, n_removed, n_spans, kept, left)`` of each row;
    ``kept`` is what is left of the text, as bytes, ``left`` the same as text:
    without the rest of characters that a cut parts.

    Null text counts as empty; a text shorter than ``length`` loses nothing. Rows
    are texts of their own whatever their ids, so repeated rows lose all their
    windows; null ids are fine. An empty table gives no rows; further columns are
    ignored. Bytes are judged on the input: overlaps count and nothing is judged
    anew after removal. A cut may part a character.

    With ``words`` only runs of repeated windows that hold so many whole words go,
    and none of these is missed for being short: texts in which so many words have
    fewer than ``length`` bytes are searched by the least bytes that they can have, too.
    """
    least = 2 * words - 1
    if length < GRAM + 2 * WORD:
        raise ValueError(f"length must be at least {GRAM + 2 * WORD}")
    if words and least < GRAM + 2 * WORD:
        raise ValueError(f"words must be 0 or at least {GRAM // 2 + WORD + 1}")
    sizes_of = F.lit(length).alias("size")
    spans = repeated_spans(docs, length, id_col, text_col, hot).select("d", "r", F.struct(sizes_of, "starts").alias("x"))
    if words and least < length:
        short = materialize(has_short_words(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), words, length, text_col), "short")
        spans = spans.unionByName(repeated_spans(short, least, id_col, text_col, hot).select("d", "r", F.struct(F.lit(least).alias("size"), "starts").alias("x")))
    # A text has one list of each length at most.
    spans = materialize(spans.groupBy("d", "r").agg(F.collect_list("x").alias("starts")), "starts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), *keep).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text, F.col(id_col).isNull()).alias("r"), text.alias("text"))
    out = rows.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add("left", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, left, whole = [], [], [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                sizes.append(len(text))
                gone = _gone(text, starts.values.to_pylist() if starts.is_valid else [], words)
                raw = np.frombuffer(text, np.uint8)
                removed.append(int(gone.sum()))
                runs.append(len(_runs(gone)[0]))
                left.append(raw[~gone].tobytes())
                whole.append(raw[~_whole_characters(raw, gone)].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(left, pa.binary()), pa.array(whole, pa.string())], out.names)

    if few(spans):
        # Only texts that lose something are shuffled or seen by Python.
        keys = F.broadcast(spans.select("d", "r"))
        some = rows.join(keys, ["d", "r"], "left_semi")
        rest = rows.join(keys, ["d", "r"], "left_anti")
        whole = rest.select("row", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").alias("kept"), F.col("text").cast("string").alias("left"))
        cut = some.join(spans, ["d", "r"]).select("row", "text", "starts").transform(map_batches, run, out).unionByName(whole)
    else:
        cut = rows.join(spans, ["d", "r"], "left").select("row", "text", "starts").transform(map_batches, run, out)
    return cut.select("row.*", "n_bytes", "n_removed", "n_spans", "kept", "left")


def _gone(text: bytes, lists: list[dict], words: int) -> np.ndarray:
    """Which bytes go, from the starts of repeated windows of each size."""
    step = np.zeros(len(text) + 1, np.int64)
    if words and lists:
        begin, end = words_in(text)
    for found in lists:
        size, mark = found["size"], np.zeros(len(text) + 1, np.int64)
        flat = np.array([(x["s"], x["e"]) for x in found["starts"]], np.int64).reshape(-1, 2)
        np.add.at(mark, flat[:, 0], 1)
        np.add.at(mark, flat[:, 1] + 1, -1)
        s, e = _runs(np.cumsum(mark) > 0)
        e = e + size
        if words:
            enough = np.searchsorted(end, e, side="right") - np.searchsorted(begin, s) >= words
            s, e = s[enough], e[enough]
        np.add.at(step, s, 1)
        np.add.at(step, e, -1)
    return np.cumsum(step[:-1]) > 0


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, and all bytes of a character of which one is gone."""
    if not gone.any():
        return gone
    character = np.cumsum((raw & 0xC0) != 0x80)
    return np.bincount(character, gone)[character] > 0

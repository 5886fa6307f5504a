"""Benchmark decontamination: test items within documents, up to some errors.

An item of m bytes may be found with up to k edits. Parted into k + 1 pieces, at
least one piece of it is untouched in any such occurrence, so exact hits of
pieces are all that needs a closer look: a rolling 12-byte window is looked up in
a bit table, survivors in a dictionary, and around each hit Myers' bit-parallel
algorithm gives the smallest edit distance of the whole item and where it ends.

Texts are compared in a plain form: lower case, and each run of ASCII characters
that are neither letters nor digits is one blank.

Documents are read once per block of items and never shuffled; a block holds a
bounded number of bytes, so what is broadcast is bounded whatever the set of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.llm.common import map_batches

#: One edit is allowed per so many bytes of an item, as long as each piece has PIECE bytes.
BYTES_PER_EDIT, PIECE = 16, 12
#: Items of fewer plain bytes are exact only, and not within a word; those shorter than a piece aren't searched (see ``unsearched``).
LOOSE = 20
#: Bytes of items in one broadcast block.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split())


def edits_allowed(size: int) -> int:
    return max(0, min(size // BYTES_PER_EDIT, size // PIECE - 1))


class Item:
    """A pattern with its bit masks."""

    def __init__(self, item_id, text: bytes):
        self.item_id, self.text, self.k = item_id, text, edits_allowed(len(text))
        self.masks: dict[int, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> list[tuple[int, bytes]]:
        n = self.k + 1
        edges = [len(self.text) * i // n for i in range(n + 1)]
        return [(i, self.text[i:j]) for i, j in zip(edges, edges[1:], strict=False)]

    def nearest(self, window: bytes) -> tuple[int, int]:
        """(edit distance of the item to the nearest substring, its end)."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, now, best, end = full, 0, m, m, 0
        get = self.masks.get
        for i, c in enumerate(window, 1):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (~(xh | plus) & full)
            mh = plus & xh
            if ph & top:
                now += 1
            elif mh & top:
                now -= 1
            ph <<= 1
            plus = ((mh << 1) | ~(xv | ph)) & full
            minus = ph & xv & full
            if now < best:
                best, end = now, i
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, bytes]]):
        self.items = [Item(i, t) for i, t in items]
        self.first: dict[bytes, list[tuple[Item, int, bytes]]] = {}
        for item in self.items:
            for at, piece in item.pieces():
                self.first.setdefault(piece[:PIECE], []).append((item, at, piece))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        for key in self.first:
            self.table[self._hash(key + b"\0" * 8)[0]] = True
        self.seen: dict[tuple[int, bytes], int] = {}

    @staticmethod
    def _hash(data: bytes) -> np.ndarray:
        """Of the 12 bytes from each position on."""
        n = len(data) - PIECE + 1
        a = np.ndarray((n,), "<u8", data, strides=(1,))
        b = np.ndarray((n,), "<u4", data, 8, strides=(1,)).astype(np.uint64)
        return ((a * _C1) ^ (b * _C2)) >> np.uint64(64 - _TABLE_BITS)

    def find(self, texts: list[bytes]) -> list[dict]:
        """For each plain text, the smallest distance of each item found in it, and how much is allowed."""
        found: list[dict] = [{} for _ in texts]
        if not self.first:
            return found
        data = b"\0".join(texts) + b"\0" * 16
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        hits = np.flatnonzero(self.table[self._hash(data)])
        of = np.searchsorted(starts, hits, side="right") - 1
        tried: set = set()
        for p, d in zip(hits.tolist(), of.tolist(), strict=True):
            for item, at, piece in self.first.get(data[p : p + PIECE], ()):
                if data[p : p + len(piece)] != piece or (d, id(item), p - at) in tried:
                    continue
                tried.add((d, id(item), p - at))
                best = found[d].get(item.item_id, (item.k + 1, 0))
                if best[0] == 0:
                    continue
                base, stop = int(starts[d]), int(starts[d + 1]) - 1
                if len(item.text) < LOOSE and not (_parted(data, p) and _parted(data, p + len(item.text))):
                    continue
                distance = self._distance(item, data, p - at, base, stop)
                if distance <= item.k and (distance, item.k) < best:
                    found[d][item.item_id] = (distance, item.k)
        return found

    def _distance(self, item: Item, data: bytes, start: int, base: int, stop: int) -> int:
        if start >= base and data[start : start + len(item.text)] == item.text:
            return 0
        window = data[max(base, start - item.k) : min(stop, start + len(item.text) + item.k)]
        key = (id(item), window)
        if key not in self.seen:
            if len(self.seen) >= 20_000:
                self.seen.clear()
            self.seen[key] = item.nearest(window)[0]
        return self.seen[key]


def _parted(data: bytes, at: int) -> bool:
    """Whether no ASCII word goes on across this place."""
    return at == 0 or not all(c < 128 and chr(c).isalnum() for c in data[at - 1 : at + 1])


def unsearched(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``items`` that :func:`find_items` can't search: without an id or a
    text, or with fewer than ``PIECE`` plain bytes."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(names.index(c)) for c in (item_id, item_text))
            yield batch.filter(pa.array([not i.is_valid or len(plain(t.as_py())) < PIECE for i, t in zip(ids, texts, strict=True)], pa.bool_()))

    return items.transform(map_batches, run, items.schema)


def _id_kind(items: DataFrame, id_col: str) -> str:
    """Ids of items travel as whole numbers or as text."""
    return "bigint" if isinstance(items.schema[id_col].dataType, T.IntegralType) else "string"


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about ``BLOCK_BYTES``, one at a time."""
    src = items.select(F.col(id_col).cast(_id_kind(items, id_col)).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = src.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        rows = src.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield [(r.item_id, t) for r in rows if len(t := plain(r.text)) >= PIECE]


_MATCHERS: dict[int, Matcher] = {}


def _matcher(sent) -> Matcher:
    """The block's matcher, built once per Python worker."""
    if sent.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[sent.id] = Matcher(sent.value)
    return _MATCHERS[sent.id]


class _Sent:
    """A broadcast and its number."""

    def __init__(self, context, value):
        self.box = context.broadcast(value)
        self.id = self.box._jbroadcast.id()

    def __getstate__(self):
        return {"box": self.box, "id": self.id}

    @property
    def value(self):
        return self.box.value


def _slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    texts, held, start = [], 0, 0
    for i, x in enumerate(column):
        texts.append(plain(x.as_py()))
        held += len(texts[-1])
        if held >= most:
            yield start, texts
            texts, held, start = [], 0, i + 1
    if texts:
        yield start, texts


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance, allowed)``: a row for each row of ``docs`` and
    each item found in it, with the smallest number of edits (bytes inserted,
    deleted or replaced in the plain form) and how many are allowed.

    Null texts and ids of items are no items, nor are items of fewer than
    ``PIECE`` plain bytes (:func:`unsearched` returns them); shorter ones than
    ``LOOSE`` must be exact and stand between words. Equal items with different ids are
    found each, and of different items with one id the nearest counts. Null and empty
    documents hold nothing; rows with equal or null ids are searched each.
    Without documents or items there are no rows; further columns are ignored.
    ``docs`` is read once per block of items and must give its rows in the same order
    each time, as tables do.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = [src.schema["doc_id"].dataType.simpleString(), _id_kind(items, item_id)]
    schema = f"row long, doc_id {kinds[0]}, item_id {kinds[1]}, distance long, allowed long"
    out, several = None, False
    for block in _blocks(items, item_id, item_text):
        sent = _Sent(docs.sparkSession.sparkContext, block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent)
            for batch in batches:
                for start, texts in _slices(batch.column(1)):
                    rows = [(start + i, item, n, k) for i, hits in enumerate(matcher.find(texts)) for item, (n, k) in hits.items()]
                    if rows:
                        at, item, n, k = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at)), batch.column(0).take(pa.array(at)), pa.array(item), pa.array(n, pa.int64()), pa.array(k, pa.int64())], ["row", "doc_id", "item_id", "distance", "allowed"])

        found = src.transform(map_batches, run, schema)
        out, several = found if out is None else out.unionByName(found), out is not None
    if several:  # an id may have items in different blocks
        out = out.groupBy("row", "doc_id", "item_id").agg(F.min(F.struct("distance", "allowed")).alias("x")).select("doc_id", "item_id", "x.*")
    return out.select("doc_id", "item_id", "distance", "allowed") if out is not None else src.select("doc_id", F.lit(None).cast(kinds[1]).alias("item_id"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("allowed")).where("false")


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Narrow."""
    place = docs.columns.index(text_col)
    for block in _blocks(items, item_id, item_text):
        sent = _Sent(docs.sparkSession.sparkContext, block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent)
            for batch in batches:
                clean = [not hits for _, texts in _slices(batch.column(place)) for hits in matcher.find(texts)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.transform(map_batches, run, docs.schema)
    return docs

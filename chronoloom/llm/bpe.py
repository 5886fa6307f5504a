"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut wherever a hash of the last eight bytes has ten zero bits, so
equal passages give equal chunks in any document. A chunk is encoded once per
Python worker: its ids are kept in a bounded cache that outlives Arrow batches
and tasks. Joins are then repaired. What a chunk's ids say about its first and last few
tokens may be wrong in its surrounding, so the window around a join is encoded anew: from
the last but one *certain* boundary of the chunk before to the second one of the chunk
behind. Its ids must agree with the first chunk's up to that one's last certain boundary,
and with the second chunk's from its first one on; what lies between replaces both chunks'
ids. The window grows over chunks without two such boundaries, and if both sides still
don't agree, to the whole text. Equal windows are encoded once, too.

A boundary is certain at a single space that stands between two visible ASCII
characters: no alternative of the pre-tokenizer's pattern matches a space after
another character, so a pre-token starts there whatever stands around it. The same holds
at an ideographic comma or full stop and the wide forms of ``, ! ?`` behind a Han or
Hiragana letter: no alternative matches letters and punctuation together. No special
token holds a space or such a character. Ids that agree between two such boundaries are
therefore the whole text's; agreement elsewhere would prove nothing.

The work is narrow: no shuffle, memory bounded by one Arrow batch and the cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches

#: One cut per 1,024 bytes on average.
CUT_BITS = 10
#: Bytes of distinct text whose ids one Python worker remembers.
CACHE_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _load(path: str):
    """(encoding, bytes of each id, their lengths) of a byte-level BPE file."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if any(" " in t["content"] or not t["content"].isascii() for t in spec["added_tokens"]):
        raise ValueError(f"{path}: a special token may cross a certain boundary")
    alphabet = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [ranks[bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: merge order and ids differ")
    encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    table = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, i in ranks.items():
        table[i] = token
    for token, i in special.items():
        table[i] = token.encode()
    return encoding, table, np.array([len(t) for t in table])


class _Cache(dict):
    """Ids by chunk or window of text; emptied when it holds too many bytes."""

    def __init__(self, encoding, limit: int):
        super().__init__()
        self.encoding, self.limit, self.held = encoding, limit, 0

    def __missing__(self, piece: bytes):
        ids = self.encoding.encode_to_numpy(piece.decode("utf-8", "replace"), allowed_special="all").astype(np.int32)
        if len(piece) <= self.limit >> 4:
            self.held += len(piece) + 200
            if self.held > self.limit:
                self.clear()
                self.held = len(piece) + 200
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache(_load(path)[0], CACHE_BYTES)


#: Three bytes of each: ideographic comma and full stop, wide comma, exclamation and question mark.
_STOPS = np.array([int.from_bytes(c.encode(), "big") for c in "、。，！？"])


def certain(b: np.ndarray) -> np.ndarray:
    """The certain boundaries in a text, judged by three bytes on either side."""
    visible = (b > 0x20) & (b < 0x7F)
    at = np.flatnonzero((b[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1
    wide = np.flatnonzero((b[3:-2] == 0xE3) | (b[3:-2] == 0xEF)) + 3
    if not len(wide):
        return at
    code = (b[wide].astype(int) << 16) | (b[wide + 1].astype(int) << 8) | b[wide + 2]
    lead = b[wide - 3]
    letter = ((lead >= 0xE5) & (lead <= 0xE8)) | ((lead == 0xE3) & (b[wide - 2] == 0x81) & (b[wide - 1] > 0x80))
    return np.union1d(at, wide[letter & np.isin(code, _STOPS)])


def chunks(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, whether each chunk has anchors, anchors) of the documents of ``data``.

    ``starts`` holds where each document starts, and the end; chunks never cross
    documents or part a character. A chunk's four anchors are its first two and
    last two certain boundaries, judged by its own bytes alone.
    """
    n, b = len(data), np.frombuffer(data, np.uint8)
    cut = np.empty(0, np.int64)
    if n >= 32:
        window = np.ndarray((n - 7,), "<u8", data, strides=(1,))
        cut = np.flatnonzero((window * _MIX) >> np.uint64(64 - CUT_BITS) == 0) + 8
        for _ in range(3):
            cut = cut[cut < n]
            cut = cut + ((b[cut] & 0xC0) == 0x80)
    edges = np.union1d(cut[cut < n], starts)
    safe = certain(b)
    lo = np.searchsorted(safe, edges[:-1] + 3)
    hi = np.searchsorted(safe, edges[1:] - 3, side="right") - 1
    some = hi > lo
    anchors = np.zeros((len(lo), 4), np.int64)
    anchors[some] = safe[np.stack([lo, lo + 1, hi - 1, hi], 1)[some]]
    return edges, some, anchors


def _between(window: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The ids of a window without those that it shares with the chunks on either side; None if they differ."""
    end = len(window) - len(right)
    if end < len(left) or window[: len(left)].tobytes() != left.tobytes() or window[end:].tobytes() != right.tobytes():
        return None
    return window[len(left) : end]


def encode_texts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of each text)."""
    cache, lengths = _cache(path), _load(path)[2]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    data, none = b"".join(texts), np.empty(0, np.int32)
    edges, some, anchors = chunks(data, np.unique(starts))
    of = np.searchsorted(edges, starts).tolist()
    cuts, some, inside, anchors = edges.tolist(), some.tolist(), anchors - edges[:-1, None], anchors.tolist()

    def stitch(i: int, j: int) -> list[np.ndarray] | None:
        """Ids of the document of chunks i to j - 1, in parts; None if a join's two sides don't agree."""
        parts, start, left = [], cuts[i], none
        for k in range(i, j):
            if not some[k]:
                continue  # the window grows over it
            ids = cache[data[cuts[k] : cuts[k + 1]]]
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, inside[k])
            if (ends[at] != inside[k]).any():
                return None
            first, second, third, last = (at + 1).tolist()
            if k == i:
                first = 0
            else:
                middle = _between(cache[data[start : anchors[k][1]]], left, ids[first:second])
                if middle is None:
                    return None
                parts.append(middle)
            if k == j - 1:
                return [*parts, ids[first:]]
            parts.append(ids[first:last])
            start, left = anchors[k][2], ids[third:last]
        middle = _between(cache[data[start : cuts[j]]], left, none)
        return None if middle is None else [*parts, middle]

    parts, sizes = [none], [0]
    for i, j in zip(of, of[1:], strict=False):
        if j > i:
            one = [cache[data[cuts[i] : cuts[j]]]] if j == i + 1 else stitch(i, j)
            parts += one if one is not None else [cache[data[cuts[i] : cuts[j]]]]
            sizes.append(sizes[-1] + sum(map(len, one if one is not None else parts[-1:])))
        else:
            sizes.append(sizes[-1])
    return np.concatenate(parts), np.array(sizes, np.int64)


def _slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about ``most`` bytes; null counts as empty."""
    texts, held, start = [], 0, 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        texts.append(x.as_py() or b"")
        held += len(texts[-1])
        if held >= most:
            yield start, texts
            texts, held, start = [], 0, i + 1
    if texts:
        yield start, texts


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of each row's whole text.

    Null text counts as empty and gives no ids; rows with equal or null ids stay
    rows of their own; further columns are ignored, whatever their names.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids, offsets = encode_texts(texts, path)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists], ["doc_id", "ids"])

    return src.transform(map_batches, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _decoder(path: str):
    table = _load(path)[1]
    known = range(len(table))

    def decode(ids: list) -> str:
        try:
            data = b"".join(map(table.__getitem__, ids))
            if ids and min(ids) < 0:
                raise IndexError
        except (IndexError, TypeError):
            data = b"".join(table[int(i)] for i in ids if i is not None and i in known)
        return data.decode("utf-8", "replace")

    return decode


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, text)``: :func:`encode_documents` and then
    :func:`decode_documents`, in one pass of one Python worker a task."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(path)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids, offsets = encode_texts(texts, path)
                cuts, flat = offsets.tolist(), ids.tolist()
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                back = pa.array([decode(flat[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists, back], ["doc_id", "ids", "text"])

    return src.transform(map_batches, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text)``: the text that each row's ids stand for.

    Special tokens are kept; bytes that are no UTF-8 become U+FFFD; null ids
    count as none and give empty text; an id outside the vocabulary gives no
    bytes.
    """
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(path)
        for batch in batches:
            texts = [decode(x.values.to_pylist() if x.is_valid else []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return src.transform(map_batches, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")

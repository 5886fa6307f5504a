"""Language identification with a convolutional network over bytes.

Filters of several widths slide over the bytes of a fixed-length window; each
keeps its largest response, and a softmax layer tells the languages apart. The
network is trained in numpy on a bounded sample of labelled rows and applied in
Arrow batches to windows that cover every byte of every text; a text's answer is
the softmax of its windows' mean logits. Scoring is narrow: no shuffle, and what
is broadcast is the network, whose size depends on its parameters alone.

A filter over one-hot bytes is a sum of table rows, so two neighbouring bytes are
looked up at once in tables that each Python worker builds from the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The sample for training: so many texts of each language, in all at most so many, and so many characters of each text from a place that its hash names.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS = 240, 61_440, 2048
UNKNOWN = "und"
_STEP = WINDOW - max(WIDTHS) + 1
#: Case of ASCII letters says nothing about the language.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Network:
    """tables[i][j] has, for width WIDTHS[i] and place j in it, a row per byte."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all windows as rows of bytes, of which text each is).

    ``starts`` has where each text begins, and the end. The last window of a text
    ends where the text ends; a text shorter than a window is filled with blanks.
    """
    lengths = np.diff(starts)
    count = np.maximum(1, -(-(lengths - WINDOW) // _STEP) + 1)
    of = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(nth * _STEP, np.maximum(lengths[of] - WINDOW, 0)) + starts[:-1][of]
    padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    rows = padded[at[:, None] + np.arange(WINDOW)]
    for i in np.flatnonzero(lengths[of] < WINDOW):
        rows[i, lengths[of[i]] :] = 32
    return _FOLD[rows], of


def train(texts: list[bytes], labels: list[str], epochs: int = 4, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit a network with Adam on the windows of ``texts``."""
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(x) for x in labels], int)
    data = np.frombuffer(b"".join(texts), np.uint8)
    x, of = windows(data, np.cumsum([0, *map(len, texts)]))
    y = y[of]
    weight = 1 / np.maximum(1, np.bincount(y, minlength=len(languages)))[y]
    weight *= len(y) / max(weight.sum(), 1e-12)
    rng = np.random.default_rng(seed)
    p = {f"t{w}": rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    total = FILTERS * len(WIDTHS)
    p |= {"b": np.zeros(total, np.float32), "d": rng.normal(0, 1 / np.sqrt(total), (total, len(languages))).astype(np.float32), "e": np.zeros(len(languages), np.float32)}
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            xb, pooled, where = x[pick], [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = sum(p[f"t{w}"][j][xb[:, j : j + n]] for j in range(w))
                best = z.argmax(1)
                where.append(best)
                pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + p["b"]
            act = np.maximum(raw, 0)
            logits = act @ p["d"] + p["e"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(pick)), y[pick]] -= 1
            down = prob * (weight[pick] / len(pick))[:, None]
            back = (down @ p["d"].T) * (raw > 0)
            grad = {"d": act.T @ down, "e": down.sum(0), "b": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(p[f"t{w}"])
                part, f = back[:, i * FILTERS : (i + 1) * FILTERS], np.arange(FILTERS)
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(xb, where[i] + j, 1), np.broadcast_to(f, part.shape)), part)
                grad[f"t{w}"] = g
            step += 1
            for name, g in grad.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.001 * (g * g - square[name])
                p[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, tuple(p[f"t{w}"] for w in WIDTHS), p["b"], p["d"], p["e"])


class Scorer:
    """Applies a network; builds the two-byte tables once."""

    def __init__(self, net: Network):
        self.net = net
        lo, hi = np.arange(65536) & 255, np.arange(65536) >> 8  # little-endian pairs
        pair = [t[0][lo] + t[1][hi] for t in net.tables]
        self.heads = np.ascontiguousarray(np.concatenate(pair, 1))
        self.third = np.ascontiguousarray(net.tables[1][2])
        self.tail = np.ascontiguousarray(net.tables[2][2][lo] + net.tables[2][3][hi])

    def logits(self, rows: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty((len(rows), len(self.net.languages)), np.float32)
        for k in range(0, len(rows), block):
            x = rows[k : k + block]
            pairs = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
            z = self.heads[pairs]
            z[:, :-1, FILTERS : 2 * FILTERS] += self.third[x[:, 2:]]
            z[:, :-2, 2 * FILTERS :] += self.tail[pairs[:, 2:]]
            pooled = np.concatenate([z[:, :, :FILTERS].max(1), z[:, :-1, FILTERS : 2 * FILTERS].max(1), z[:, :-2, 2 * FILTERS :].max(1)], 1)
            out[k : k + block] = np.maximum(pooled + self.net.bias, 0) @ self.net.dense + self.net.dense_bias
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        starts = np.cumsum([0, *map(len, texts)])
        rows, of = windows(np.frombuffer(b"".join(texts), np.uint8), starts)
        sums = np.add.reduceat(self.logits(rows).astype(np.float64), np.searchsorted(of, np.arange(len(texts))), axis=0)
        logits = sums / np.bincount(of)[:, None]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        return [self.net.languages[i] for i in best], prob[np.arange(len(best)), best]


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on a bounded sample of the labelled rows that are not held out.

    Takes the ``PER_LANGUAGE`` rows of each language with the smallest hash of
    text, fewer of each where there are so many languages that this would be more than
    ``SAMPLE_ROWS``; no language is left out. None without any row.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rank = F.xxhash64(text)
    usable = docs.where(~held_out & lang.isNotNull() & text.rlike(r"\p{L}")).select(
        lang.alias("lang"), rank.alias("rank"), F.substring(text, (F.pmod(rank, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("piece")
    )
    first = W.partitionBy("lang").orderBy("rank", "piece")
    sample = usable.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PER_LANGUAGE)
    rows = sample.orderBy("nth", "lang").limit(SAMPLE_ROWS).collect()
    rows.sort(key=lambda r: (r.lang, r.nth))
    return train([r.piece.encode() for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, lang_pred, score)`` of each row's whole text.

    Null text and text without a letter get ``und`` and score 0, as do all rows
    if there is no network; of languages that tie the first in order wins. Equal texts get equal answers; rows with equal or null
    ids stay rows of their own; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), *keep, F.when(text.rlike(r"\p{L}"), text).alias("_text"))
    kept = src.drop("_text").schema
    sent = src.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value) if sent.value else None
        for batch in batches:
            for start, texts in _runs(batch.column(batch.num_columns - 1)):
                langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                some = [i for i, t in enumerate(texts) if t]
                if some and scorer:
                    langs[some], scores[some] = scorer.predict([texts[i] for i in some])
                old = [c.slice(start, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*old, pa.array(langs, pa.string()), pa.array(scores)], [*batch.schema.names[:-1], "lang_pred", "score"])

    return src.transform(map_batches, run, kept.add("lang_pred", "string").add("score", "double"))


def accepted(docs: DataFrame, net: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known: the
    text has a letter and the network's answer a score of ``least`` or more."""
    place = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value) if sent.value else None
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for start, texts in _runs(batch.column(place)):
                some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t.decode("utf-8", "replace")))]
                if some and scorer:
                    good[start + np.array(some)] = scorer.predict([texts[i] for i in some])[1] >= least
            yield batch.filter(pa.array(good))

    return docs.transform(map_batches, run, docs.schema)


def _runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    texts, held, start = [], 0, 0
    for i, x in enumerate(column.cast(pa.large_binary())):
        texts.append(x.as_py())
        held += len(texts[-1] or b"")
        if held >= most:
            yield start, texts
            texts, held, start = [], 0, i + 1
    if texts:
        yield start, texts


@lru_cache(maxsize=1)
def _scorer_of(key: bytes, box) -> Scorer:
    return Scorer(box.net)


class _Box:
    """Hashes by nothing, so that the cache goes by the key alone."""

    def __init__(self, net):
        self.net = net

    def __eq__(self, other):
        return True

    def __hash__(self):
        return 0


def _scorer(net: Network) -> Scorer:
    return _scorer_of(net.dense.tobytes() + net.tables[0].tobytes()[:4096], _Box(net))

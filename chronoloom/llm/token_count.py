"""Token counts of a unigram tokenizer, without building the tokens.

For each distinct word an Aho-Corasick automaton over the vocabulary gives every
piece that ends at each character. Dynamic programming over the ends carries the
best score and the number of pieces on the best way there, nothing else: there
is no way back to follow. Ties go as in the tokenizers library's unigram model:
a later candidate wins only with a strictly higher score, and candidates come by
ascending start, so the longest piece is kept.

Blanks become U+2581, one is put in front of a text that has none, and each U+2581
starts a word. Words are counted on their own and their counts are kept in a
bounded cache per Python worker. The work is narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import map_batches

BLANK = "▁"
#: How much worse than the worst piece an unknown character is (fixed value of the tokenizers library).
UNKNOWN_PENALTY = 10.0
#: Words whose counts one Python worker remembers, in two generations.
CACHE_WORDS = 400_000


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) by id of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()))


class Counter(dict):
    """Number of tokens by word, computed when first asked for."""

    def __init__(self, vocabulary, byte_fallback: bool = True, limit: int = CACHE_WORDS):
        import ahocorasick

        super().__init__()
        self.older: dict[str, int] = {}
        self.limit, self.known = limit, {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.by_bytes = byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.count(word)
        if len(word) <= 64:
            if len(self) >= self.limit // 2:  # words in use stay: what is asked for again moves on
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        """Pieces on the best way through ``word``. Unknown characters next to
        each other are one unknown token or, with byte fallback, their bytes."""
        score, count, run = [0.0], [0], [0]  # run: since where only unknown characters
        match = self.automaton.iter(word)
        end, found = next(match, (-1, None))
        for at, char in enumerate(word):
            best, n, since, single = None, 0, at + 1, False
            while end == at:
                length, s = found
                start = at + 1 - length
                single |= length == 1
                if best is None or score[start] + s > best:
                    best, n = score[start] + s, count[start] + 1
                end, found = next(match, (-1, None))
            if not single and (best is None or score[at] + self.unknown > best):
                best, since = score[at] + self.unknown, run[at]
                base = count[since]
                if word[since : at + 1] in self.known:
                    n = base + 1
                else:
                    n = base + (len(word[since : at + 1].encode("utf-8", "surrogatepass")) if self.by_bytes else 1)
            score.append(best)
            count.append(n)
            run.append(since)
        return count[-1]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def count_text(text: str, counter: Counter) -> int:
    if not text:
        return 0
    words = text.replace(" ", BLANK).split(BLANK)
    if not words[0]:
        del words[0]
    return sum(map(counter.__getitem__, [BLANK + w for w in words]))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of each row's whole text.

    Null and empty text have no tokens; rows with equal or null ids stay rows of
    their own; further columns are ignored, whatever their names.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            counts = [count_text(x.as_py() or "", counter) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return src.transform(map_batches, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long")

"""Training-corpus pipeline: each stage applies one corpus operator to all that the
stage before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``docs``; the
last one returns tokens. Between stages the documents are written to the shared
folder and read again, so a lost executor costs one stage at most. Documents are
told apart by row, so ids may repeat or be null; null texts go with the first
stage, as they have no language; empty tables stay empty, and further columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, decontaminate, language, minhash, suffix
from chronoloom.llm.common import few, held_out, materialize, read
from chronoloom.llm.queries import tokenizer_path

#: How far of the way from chance (one in so many languages as were learned) to certainty a score must be; real texts lie far above it.
LEAST_MARGIN = 1 / 15
#: Passages of so many words go if they repeat.
REPEAT_WORDS = 51
#: All texts are searched for repeats of so many bytes, those in which so many words can be shorter for shorter ones, too.
REPEAT_BYTES = 240


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a recognisable language go."""
    net = language.fit(docs, held_out(F.col("doc_id"), 4, 2))
    chance = 1 / len(net.languages) if net else 1.0
    return language.accepted(docs, net, chance + (1 - chance) * LEAST_MARGIN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates (shingles of five words,
    similarity of 0.8 or more) the document with the smallest id stays, one with a null
    id only if all are null. Rows are linked by numbers of their own, so of rows with
    one id, too, just one stays."""
    row = "_row" + "_" * max(map(len, docs.columns))  # no column's name
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered, width=5, num=80, den=100, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    ids = numbered.select(row, F.col("doc_id").cast("long").alias("id"))
    first = found.join(ids, row).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(row).alias("row"))).alias("x"))
    stays = materialize(first.select(F.col("x.row").alias(row)), "stays")
    # Those that go are the fewer ones; while their numbers can be broadcast no text is shuffled.
    gone = materialize(numbered.select(row).join(stays, row, "left_anti"), "gone")
    return numbered.join(F.broadcast(gone) if few(gone) else gone, row, "left_anti").select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages of more than 50 words that repeat go from all texts; characters that a cut
    parts go with them. The documents themselves stay."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias("_no_text" + "_" * max(map(len, docs.columns)))).alias("row"))
    found = suffix.remove_repeats(rows, length=REPEAT_BYTES, keep=("row",), words=REPEAT_WORDS)
    no_text = F.col("row").getField(rows.schema["row"].dataType.names[-1])
    cut = F.col("n_removed") > 0
    new = {"text": F.when(~no_text, F.col("left"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("left")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids of every text that is left, and the text that they decode to."""
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", remove_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: No stage but one can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Context trees of every depth against dictionaries; the depth that the query uses."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import ctw, queries
from chronoloom.llm.common import held_out


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0


def brute_model(texts, deepest):
    """Natural-log probability of a byte after ``deepest`` others."""
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in texts:
        d = b"\0" * deepest + t
        for i in range(deepest, len(d)):
            for k in range(8):
                node = (256 | d[i]) >> (8 - k)
                for depth in range(deepest + 1):
                    c = d[i - depth : i]
                    count[node, c][d[i] >> (7 - k) & 1] += 1
                    if depth:
                        kids[node, c[1:]].add(c)
    known = {}

    def mix(node, c):
        if (node, c) not in known:
            own = kt(*count[node, c])
            known[node, c] = own if len(c) == deepest else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(mix(node, x) for x in kids[node, c]))
        return known[node, c]

    def p(node, before, depth=0):
        c = before[deepest - depth :]
        n = count.get((node, c), [0, 0])
        here = (n[1] + 0.5) / (sum(n) + 1)
        if depth == deepest:
            return here
        w = math.exp(math.log(0.5) + kt(*n) - mix(node, c)) if sum(n) else 0.5
        return w * here + (1 - w) * p(node, before, depth + 1)

    def log_p(before, byte):
        ones = [p((256 | byte) >> (8 - k), before) for k in range(8)]
        return sum(math.log(x if byte >> (7 - k) & 1 else 1 - x) for k, x in enumerate(ones))

    return log_p


@pytest.mark.parametrize(("depth", "top"), [(0, 10), (1, 10), (3, 0), (5, 0), (5, 60), (5, ctw.TOP)])
def test_every_depth(spark, monkeypatch, depth, top):
    monkeypatch.setattr(ctw, "TOP", top)
    monkeypatch.setattr(ctw, "RUN", 5)
    rnd = random.Random(4)
    words = ["abra", "cadabra", "the", "hat", "Ünknown", "日本"]
    rows = [(i, " ".join(rnd.choices(words[: 4 + i % 3], k=rnd.randint(1, 12)))) for i in range(24)] + [(30, None), (31, ""), (None, "cat"), (3, "the hat")]
    out = F.col("doc_id") % 4 == 2
    found = ctw.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), out, depth=depth).collect()
    log_p = brute_model([(t or "").encode() for i, t in rows if i is None or i % 4 != 2], depth)

    def want(t):
        d = b"\0" * depth + (t or "").encode()
        return sum(log_p(d[k - depth : k], d[k]) for k in range(depth, len(d))) / math.log(10)

    got = sorted((str(r.doc_id), r.n_bytes, r.score) for r in found)
    for (i, n, x), (j, m, y) in zip(got, sorted((str(i), len((t or "").encode()), want(t)) for i, t in rows), strict=True):
        assert (i, n) == (j, m) and x == pytest.approx(y, abs=1e-4)


def test_the_query_sees_five_bytes_back(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(["kxxxxm", "qxxxxw"]) for _ in range(60))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    scored = queries.op10_lm(spark, str(tmp_path)).where("held_out").collect()
    assert scored and max(r.bits_per_byte for r in scored) < 0.3  # half a bit more a word if the fifth byte before is out of sight
    assert {r.doc_id for r in scored} == {r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").where(held_out(F.col("doc_id"), 7, 2)).collect()}


def test_table_finds_what_it_holds():
    rnd = np.random.default_rng(6)
    code = np.unique(rnd.integers(0, 1 << 48, 300_000, dtype=np.uint64))
    table = ctw.Table(code[::2], np.arange(len(code[::2]), dtype=np.float32))
    nats, missed = table.find(code)
    assert np.array_equal(missed, np.arange(1, len(code), 2)) and np.array_equal(nats[::2], np.arange(len(code[::2])))

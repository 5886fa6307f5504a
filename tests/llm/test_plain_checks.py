"""Operators against plain versions of themselves, on shapes that the given tables lack."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import ctw, language, queries, urls


def network(languages, seed=1):
    rng = np.random.default_rng(seed)
    total = language.FILTERS * len(language.WIDTHS)
    tables = tuple(rng.normal(0, 1, (w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS)
    return language.Network(languages, tables, *(rng.normal(0, 1, s).astype(np.float32) for s in (total, (total, len(languages)), len(languages))))


def convolved(net, row):
    """Logits of one window: each filter at each place, then its largest answer, then the dense layer."""
    pooled = [
        max(sum(float(table[j, row[at + j], f]) for j in range(width)) for at in range(len(row) - width + 1))
        for width, table in zip(language.WIDTHS, net.tables, strict=True)
        for f in range(language.FILTERS)
    ]
    act = np.maximum(np.array(pooled) + net.bias, 0)
    return act @ net.dense.astype(float) + net.dense_bias


def test_scores_are_those_of_a_plain_convolution():
    net, rng = network(("a", "b", "c")), np.random.default_rng(2)
    rows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    rows[3], rows[4, 40:] = 32, 32
    want = np.array([convolved(net, r) for r in rows])
    assert np.allclose(language.Scorer(net).logits(rows, block=2), want, atol=1e-3)
    long = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    texts = [long, b"", long[:70], long]
    langs, scores = language.Scorer(net).predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        cut, _ = language.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        mean = np.mean([convolved(net, r) for r in cut], 0)
        prob = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert lang == net.languages[prob.argmax()] and score == pytest.approx(prob.max(), abs=1e-4)


def test_a_tie_goes_to_the_first_language():
    net = network(("x", "y", "z"))
    flat = language.Network(net.languages, net.tables, net.bias, np.zeros_like(net.dense), np.zeros(3, np.float32))
    langs, scores = language.Scorer(flat).predict([b"any text", b"another"])
    assert langs == ["x", "x"] and scores == pytest.approx([1 / 3, 1 / 3])


def test_training_follows_the_slope(monkeypatch):
    """After one small step the loss is less by what the step's own slopes promise."""
    texts = [b"the of and with " * 20, b"le des que eau " * 20] * 4
    labels = ["en", "fr"] * 4
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows, of = language.windows(data, np.cumsum([0, *map(len, texts)]))
    y = np.array([("en", "fr").index(x) for x in labels])[of]

    def loss(net):
        z = language.Scorer(net).logits(rows).astype(float)
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]))

    start, step = language.train(texts, labels, epochs=1, rate=0.0), language.train(texts, labels, epochs=1, rate=1e-4)
    # A first step of Adam moves every parameter by the rate, against the sign of its slope: ask the slope of a few by differences.
    moved = step.dense - start.dense
    for at in [(0, 0), (5, 1), (13, 0), (20, 1)]:
        ends = []
        for by in (1e-2, -1e-2):
            dense = start.dense.copy()
            dense[at] += by
            ends.append(loss(language.Network(start.languages, start.tables, start.bias, dense, start.dense_bias)))
        slope = (ends[0] - ends[1]) / 2e-2
        if abs(slope) > 1e-4:
            assert np.sign(moved[at]) == -np.sign(slope)
    assert loss(step) < loss(start)


def test_blocks_spread_over_chains_rings_and_hubs(spark):
    rnd = random.Random(4)
    page = lambda k: f"http://h{k % 7}.info/p/{k}"
    at = {k: page(k) for k in range(1500)}
    edges = [(k, k + 1) for k in range(200)]  # a chain
    edges += [(300 + k, 300 + (k + 1) % 50) for k in range(50)]  # a ring
    edges += [(400 + k, 400) for k in range(1, 600)]  # a hub
    edges += [(rnd.randrange(1000, 1500), rnd.randrange(1000, 1500)) for _ in range(200)]
    # Rules' own pages: a chain's end and the hub are blocked, the ring holds a block and an allow.
    at |= {200: "http://www.site.com/en/1", 400: "http://b.org/es/hub", 310: "http://a.net/de/2", 320: "http://example.com/en/77", 1200: "http://c.net/de/3", 1400: "http://d.org/es/4"}
    root = list(range(1500))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    own = {200: "block", 400: "block", 310: "block", 320: "allow", 1200: "block", 1400: "block"}
    held = {}
    for k, verdict in own.items():
        held.setdefault(find(k), set()).add(verdict)
    want = {k: own.get(k) or ("block" if held.get(find(k)) == {"block"} else "allow") for k in range(1500)}
    pages = spark.createDataFrame([(k, u, "x" * 200_000 if k == 7 else None) for k, u in at.items()], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(at[a], at[b]) for a, b in edges], "src string, dst string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, queries.RULES, redirects=redirects).collect()}
    assert got == want and Counter(want.values())["block"] > 800


def test_a_very_long_text_is_scored_whole(spark):
    rnd = random.Random(6)
    long = " ".join(rnd.choice(["alpha", "Beta", "γάμμα", "delta"]) for _ in range(60_000))
    rows = [(1, "alpha beta"), (2, long), (3, "delta γάμμα alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(df, F.col("doc_id") == 2).collect()}
    count = Counter(w for i, t in rows if i != 2 for w in [*t.split(), "\n"])
    total, distinct = sum(count.values()), len(count)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    want = sum(n * math.log10((count[w] + 1) / (total + distinct + 1)) for w, n in Counter([*fold(long).split(), "\n"]).items())
    assert got[2].n_tokens == 60_001 and got[2].base_score == pytest.approx(want, rel=1e-9)
    assert -len(long.encode()) * 8 * math.log10(2) < got[2].score < 0

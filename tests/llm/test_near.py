"""Near-duplicates and components against brute force."""

import random

import pytest

from chronoloom.llm import graph, minhash


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(150)] + [(500, 500 + i) for i in range(1, 60)] + [(rnd.randint(1000, 1400), rnd.randint(1000, 1400)) for _ in range(200)]
    df = spark.createDataFrame([*edges, (7, 7), (0, 1), (None, 3), (4, None)], "src long, dst long")
    got = {r.vertex: r.component for r in graph.connected_components(df).collect()}
    assert got == union_find((a, b) for a, b in edges if a != b)
    assert graph.connected_components(df.limit(0)).count() == 0


def sets_of(text, width):
    words = minhash.words_of(text)
    w = min(width, len(words))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set()


def brute(rows, width):
    sets = [(i, sets_of(t, width)) for i, t in rows]
    edges = [(i, i) for i, _ in sets] + [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return union_find(edges)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 250))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 12)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((i * 7 % 997, " ".join(copy).upper() if rnd.random() < 0.3 else "\n".join(copy)))
            i += 1
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one"), (2004, "ONE"), (2005, "two words"), (2006, "x " * 20000), (2007, "x " * 19999)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, kept string, n_shingles int")
    found = {r.doc_id: r for r in minhash.near_duplicates(df, width).collect()}
    want = brute(rows, width)
    assert {k: r.component_id for k, r in found.items()} == want
    assert all(found[k].n_shingles == len(sets_of(t, width)) and found[k].kept == (want[k] == k) for k, t in rows)


def test_members_far_from_the_smallest_are_linked(spark):
    """A chain whose ends share a bucket with the middle only, in one large group."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        copy = list(base)
        for j in range(18):
            copy[(k * 18 + j * 3) % 400] = f"n{k * 18 + j}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == brute(rows, 2)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    test_members_far_from_the_smallest_are_linked(spark)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "q r s t"), (3, "a b c d"), (4, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (-1, None, True), (3, 1, False), (3, 1, False), (4, 1, False)], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_verification_on_words():
    assert minhash.similar([b"a", b"b", b"c"], [b"a", b"b", b"c"], 2, 80, 100)
    assert not minhash.similar([b"a"], [b"a", b"b"], 2, 80, 100)
    assert minhash.similar([b"a"], [b"a"], 2, 80, 100) and not minhash.similar([b"a"], [b"b"], 2, 80, 100)
    x = [bytes([97 + i]) for i in range(11)]
    assert minhash.similar(x, [*x[:10], b"z"], 2, 80, 100) == (9 * 100 >= 80 * 11)

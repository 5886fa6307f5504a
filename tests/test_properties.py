"""Laws that hold for any series and pattern."""

import itertools
import json
import random
import re
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.functions import aggregators
from chronoloom.functions.globs import regex
from chronoloom.functions.times import EPOCH_SHIFT
from chronoloom.operators import windows
from chronoloom.operators.series import Store
from chronoloom.plans.library import FUNCTIONS, call
from chronoloom.plans.render import as_json, evaluate, render, rows

name = st.lists(st.text("abc", min_size=1, max_size=3), min_size=1, max_size=4).map(".".join)
pattern = st.lists(st.one_of(st.just("**"), st.text("abc*", min_size=1, max_size=3)), min_size=1, max_size=4).map(".".join)


def fits(pattern, name):
    """By trying every way; a trailing ``**`` stands for a segment or more."""
    p, n = tuple(pattern.split(".")), tuple(name.split("."))

    @lru_cache(None)
    def seg(a, b):
        if not a:
            return not b
        if a[0] == "*":
            return seg(a[1:], b) or bool(b) and seg(a, b[1:])
        return bool(b) and a[0] == b[0] and seg(a[1:], b[1:])

    @lru_cache(None)
    def path(i, j):
        if i == len(p):
            return j == len(n)
        if p[i] == "**":
            if i == len(p) - 1:
                return j < len(n)
            return path(i + 1, j) or j < len(n) and path(i, j + 1)
        return j < len(n) and seg(p[i], n[j]) and path(i + 1, j + 1)

    return path(0, 0)


@settings(max_examples=400, deadline=None)
@given(pattern, name)
def test_patterns_against_a_plain_matcher(p, n):
    assert bool(re.match(regex(p), n)) == fits(p, n)


@pytest.fixture(scope="module")
def store(spark):
    rnd = random.Random(11)
    steps = [60, 60, 60, 420]
    catalog = [(i, f"s.{i}", 2, steps[i], None, None) for i in range(4)]
    samples = [(i, t - (t + EPOCH_SHIFT) % steps[i], float(rnd.randint(-50, 50))) for i in range(4) for t in range(0, 6000, steps[i]) if rnd.random() < 0.6]
    return Store(spark.createDataFrame(catalog, "id long, name string, n_segs int, step long, retention long, last_t long"), spark.createDataFrame(samples, "id long, t long, v double"))


def table(store, query, points=None, first=600, last=4799):
    return {(r.name, r.skey, r.t): r.v for r in rows(evaluate(store, query, first, last, points)).collect()}


def test_sums_are_means_times_counts(store):
    total, mean = table(store, call("sum", "s.{0,1,2}")), table(store, call("avg", "s.{0,1,2}"))
    n = table(store, call("sum", call("isNonNull", "s.{0,1,2}")))
    for (a, x), (_, m), (_, k) in zip(sorted(total.items()), sorted(mean.items()), sorted(n.items()), strict=True):
        assert (x is None) == (m is None) and (x is None or abs(x - m * k) < 1e-9), a


def test_maps_keep_the_slots(store):
    want = sorted(t for _, _, t in table(store, "s.*"))
    for query in (call("scale", "s.*", 2), call("squareRoot", "s.*"), call("removeAboveValue", "s.*", 0), call("derivative", "s.*"), call("movingAverage", "s.*", 3), call("keepLastValue", "s.*")):
        assert sorted(t for _, _, t in table(store, query)) == want


def test_one_slot_a_point_changes_nothing(store):
    assert table(store, "s.[0-2]", points=10_000) == table(store, "s.[0-2]")


def test_odd_steps_align_to_the_first_epoch(store):
    times = [t for _, _, t in table(store, "s.3")]
    assert times and all((t + EPOCH_SHIFT) % 420 == 0 for t in times)


def test_only_series_of_the_first_step_are_combined(store):
    assert set(table(store, call("countSeries", "s.*")).values()) == {3.0}
    assert set(table(store, call("countSeries", "s.3", "s.0")).values()) == {1.0}


def test_long_and_short_windows_agree(store, monkeypatch):
    from chronoloom.operators import windows

    short = table(store, call("movingAverage", "s.*", 7))
    monkeypatch.setattr(windows, "SHORT_WINDOW", 2)
    long = table(store, call("movingAverage", "s.*", 7))
    assert short.keys() == long.keys()
    assert all((short[k] is None) == (long[k] is None) and (short[k] is None or abs(short[k] - long[k]) < 1e-9) for k in short)


def test_shift_there_and_back(store):
    there = call("timeShift", call("timeShift", "s.[0-2]", "10min"), "+10min")
    got = {(k[1], k[2]): v for k, v in table(store, there).items()}
    assert got == {(k[1], k[2]): v for k, v in table(store, "s.[0-2]").items()}


def test_duplicated_series_count_twice(store):
    once, twice = table(store, call("sum", "s.0")), table(store, call("sum", "s.0", "s.0"))
    assert {k[2]: v and 2 * v for k, v in once.items()} == {k[2]: v for k, v in twice.items()}


def test_retention_hides_old_samples(store):
    short = Store(store.catalog.withColumn("retention", F.lit(600).cast("long")).withColumn("last_t", F.lit(4800).cast("long")), store.samples)
    assert all(v is None for (_, _, t), v in table(short, "s.0").items() if t <= 4200)


#: What each function takes beside a path.
MORE = {"num": 2, "numOrString": 3, "aggFunc": "max", "operator": ">=", "string": "1d"}


def odd_store(spark):
    inf = float("inf")
    values = {1: [inf, -inf, 1.0, 0.0, -2.0, None, inf, 3.0, -inf, -0.0], 2: [inf, inf, None, 0.0, 2.0, 1.0, -inf, 1e300, 1e300, 5.0], 3: [None, -inf, 2.0, 7.0, 1.0, None, None, 4.0, inf, 1.0]}
    catalog = spark.createDataFrame([(i, f"a.m{i}", 2, "float64", None, 60, 0, None) for i in values], "id long, name string, n_segs int, type string, retention long, step long, creation long, last_t long")
    return Store(catalog, spark.createDataFrame([(i, 60 * k, v) for i, x in values.items() for k, v in enumerate(x) if v is not None], "id long, t long, v double"), 60)


def test_no_function_gives_nan_and_json_is_json(spark):
    store, targets = odd_store(spark), []
    for name, f in FUNCTIONS.items():
        more = [MORE.get(a.type, "x") for a in f.args[1:] if a.type != "pathOrFunc"]
        targets.append(call(name, call("derivative", call("invert", "a.*")), *more))
    for part in itertools.batched(targets, 20):
        assert not render(store, list(part), 0, 599).where("isnan(v)").select("name").collect()
    for r in as_json(render(store, [call("derivative", "a.*"), call("scale", "a.*", 0), call("movingAverage", "a.*", 2)], 0, 599)).collect():
        json.loads(r.json, parse_constant=pytest.fail)
    for agg in aggregators.NAMES:
        assert not render(store, [call("consolidateBy", "a.*", agg)], 0, 599, points=3).where("isnan(v)").count()


def test_moving_averages_by_frames_and_by_blocks_agree(spark, monkeypatch):
    store = odd_store(spark)
    for window in (1, 3, 4, 20, "2min", "10min"):
        seen = []
        for short in (1000, 0):
            monkeypatch.setattr(windows, "SHORT_WINDOW", short)
            seen.append(sorted(((r.name, r.t, r.v) for r in render(store, [call("movingAverage", "a.*", window)], 0, 599).collect()), key=str))
        slots = window if isinstance(window, int) else int(window[:-3]) + 1
        monkeypatch.setattr(windows, "SHORT_WINDOW", 1000)
        framed = sorted(((r.name, r.t, r.v) for r in render(store, [call("movingAverage", "a.*", slots)], 0, 599).collect()), key=str)
        assert [x[:2] for x in seen[0]] == [x[:2] for x in seen[1]] == [x[:2] for x in framed]
        for a, b, c in zip(seen[0], seen[1], framed, strict=True):
            assert (a[2] is None) == (b[2] is None) == (c[2] is None) and (a[2] is None or a[2] == b[2] == c[2] or abs(a[2] - c[2]) + abs(b[2] - c[2]) <= 1e-9 * abs(c[2]))

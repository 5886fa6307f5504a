"""The 29 evaluation cases: series in, request, series out."""

import json
import os

import pytest

from chronoloom.functions.times import EPOCH_SHIFT
from chronoloom.operators.series import Store
from chronoloom.plans.library import call
from chronoloom.plans.render import evaluate, rows

CASES = json.load(open(os.path.join(os.path.dirname(__file__), "goldens.json")))
V = "*.value"

#: The cases' queries as calls.
CALLS = {
    "aggregate_median": lambda: call("aggregate", V, "median"),
    "countSeries": lambda: call("countSeries", V),
    "countSeries_one": lambda: call("countSeries", V),
    "countSeries_zero": lambda: call("countSeries", V),
    "diffSeries": lambda: call("diffSeries", "all.total", call("alias", V, "values")),
    "keepLastValue": lambda: call("keepLastValue", V, 2),
    "maximumAbove": lambda: call("maximumAbove", V, 3),
    "maxSeries": lambda: call("maxSeries", V),
    "minSeries": lambda: call("minSeries", V),
    "movingAverage": lambda: call("movingAverage", V, 4),
    "movingAverage_time": lambda: call("movingAverage", V, "210s"),
    "nonNegativeDerivative": lambda: call("nonNegativeDerivative", V),
    "nonNegativeDerivative_max": lambda: call("nonNegativeDerivative", "1.value", 5),
    "scaleToSeconds": lambda: call("scaleToSeconds", V, 30),
    "stddevSeries": lambda: call("stddevSeries", V),
    "timeShift": lambda: call("timeShift", V, "2s"),
}


def store_of(spark, series, retention=None):
    catalog = [(i + 1, n, len(n.split(".")), step, retention, None) for i, (_, n, _, step, _) in enumerate(series)]
    slot = lambda t, step: t - (t + EPOCH_SHIFT) % step  # noqa: E731  as ingestion floors times
    samples = [(i + 1, slot(start + k * step, step), float(v)) for i, (_, _, start, step, vs) in enumerate(series) for k, v in enumerate(vs) if v is not None]
    return Store(
        spark.createDataFrame(catalog, "id long, name string, n_segs int, step long, retention long, last_t long"),
        spark.createDataFrame(samples, "id long, t long, v double"),
    )


def query_of(name):
    if name.startswith("consolidateBy_"):
        return call("consolidateBy", V, name.split("_")[1])
    return CALLS[name]() if name in CALLS else V


@pytest.mark.parametrize("case", CASES, ids=[c["name"] for c in CASES])
def test_golden(spark, case):
    series = [x for x in case["series"] if x[0] == "in"]
    store = store_of(spark, series)
    s = evaluate(store, query_of(case["name"]), case["first"], case["first"] + case["seconds"] - 1, case["points"])
    got: dict = {}
    for r in rows(s).collect():
        got.setdefault((r.name, r.skey, r.step), {})[r.t] = r.v
    found = sorted((n, min(p), step, [p[t] for t in sorted(p)]) for (n, _, step), p in got.items())
    want = sorted((n, start, step, vs) for kind, n, start, step, vs in case["series"] if kind == "out")
    assert [x[:3] for x in found] == [x[:3] for x in want]
    for f, w in zip(found, want, strict=True):
        assert len(f[3]) == len(w[3]), f
        for a, b in zip(f[3], w[3], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (f, w)

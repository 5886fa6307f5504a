"""Answers to requests: rows, JSON, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.times import request_time
from chronoloom.operators.leaf import as_expr
from chronoloom.operators.naming import consolidate
from chronoloom.operators.series import Expr, Request, SeriesSet, Store, dense, finite, within

#: What infinity is written as (fixed value).
LARGEST = 1.7976931348623157e308


def evaluate(store: Store, query: str | Expr, first: int, last: int, points: int | None = None) -> SeriesSet:
    """The series of ``query`` from ``first`` to ``last`` seconds, all slots of the
    window, consolidated to ``points`` if given."""
    expr, req = as_expr(query), Request(first, last)
    s = within(expr.build(store, req), req)
    if points and last > first:
        s = consolidate(dense(s) if expr.method == "count" else s, req, points, expr.method)
    return dense(s)


def rows(s: SeriesSet) -> DataFrame:
    """``(target, name, skey, arg, sid, step, t, v)``; the heads join by series."""
    return s.samples.drop("step").join(s.heads.drop("lo", "hi"), "skey").select("target", "name", "skey", "arg", "sid", "step", "t", "v")


def render(store: Store, targets: list[str | Expr], first: int | str | None = None, last: int | str | None = None, points: int | None = None, now: int = 0) -> DataFrame:
    """Rows of all targets with ``pos``, the target's place in the request."""
    a, b = request_time(first, now), request_time(last, now)
    out = None
    for i, target in enumerate(targets):
        one = rows(evaluate(store, target, a, b, points)).withColumn("pos", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a request needs a target")
    return out


def as_json(rendered: DataFrame) -> DataFrame:
    """``(pos, place, json)``: a line ``{"target": name, "datapoints": [[v, t], ...]}``
    per series, in series order; infinities are written as the largest numbers."""
    v = F.when(F.col("v") == float("inf"), F.lit(LARGEST)).when(F.col("v") == float("-inf"), F.lit(-LARGEST)).otherwise(finite(F.col("v")))
    points = F.sort_array(F.collect_list(F.struct("t", v.alias("v"))))
    series = rendered.groupBy("pos", "arg", "sid", "skey", "name").agg(points.alias("p"))
    pair = lambda p: F.concat(F.lit("["), F.coalesce(p["v"].cast("string"), F.lit("null")), F.lit(","), p["t"].cast("string"), F.lit("]"))
    name = F.expr("substring(to_json(named_struct('t', name)), 6, length(to_json(named_struct('t', name))) - 6)")
    line = F.concat(F.lit('{"target":'), name, F.lit(',"datapoints":['), F.array_join(F.transform("p", pair), ","), F.lit("]}"))
    return series.select("pos", F.struct("arg", "sid", "skey").alias("place"), line.alias("json"))


def as_records(store: Store, patterns: list[str], first: int, last: int) -> DataFrame:
    """``(name, pathExpression, start, end, step, values)`` of plain paths, each
    series once, under the first pattern that finds it."""
    out = render(store, list(patterns), first, last)
    own = out.groupBy("sid").agg(F.min("pos").alias("pos"))
    once = out.join(own, ["sid", "pos"], "left_semi")
    by = once.groupBy("sid", "name", F.col("target").alias("pathExpression"), "step")
    done = by.agg(F.min("t").alias("start"), (F.max("t") + F.first("step")).alias("end"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p"))
    return done.select("name", "pathExpression", "start", "end", "step", F.transform("p", lambda p: p["v"]).alias("values"))

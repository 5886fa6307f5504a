"""The registered queries: each operator over the whole derived series, with its SQL.

Results have ``(name, t, v)``; where a value can be infinite it is null and ``inf``
has its sign, and values that aren't whole numbers are rounded to six places on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import aggregators
from chronoloom.operators.filters import judged
from chronoloom.operators.series import Expr, Request, Store
from chronoloom.plans import views
from chronoloom.plans.library import call, path
from chronoloom.plans.render import as_json, as_records, render
from chronoloom.sources import carbon, catalog, dump
from chronoloom.sources.store import erase, reconfigure
from chronoloom.streaming import ingest

#: All 30 days of the events, hour by hour.
FIRST, LAST, STEP = 1704067200, 1706659199, 3600
EV = "ev.*.*"

Query = Callable[[SparkSession, str], DataFrame]


def _tidy(df: DataFrame, log: bool = False) -> DataFrame:
    v = F.col("v")
    infinite = F.when(v == float("inf"), 1).when(v == float("-inf"), -1).otherwise(0)
    finite = F.when(infinite == 0, F.log10(F.abs(v)) if log else v)
    return df.select("name", "t", F.round(finite, 6).alias("v"), F.coalesce(infinite, F.lit(0)).alias("inf"))


def _series(expr: Callable[[], str | Expr], points: int | None = None, log: bool = False) -> Query:
    return lambda spark, sf_dir: _tidy(render(views.events(spark, sf_dir), [expr()], FIRST, LAST, points), log)


def _grid(pre: int = 0) -> str:
    """SQL: the dense series ``g(name, sid, t, v)``, with ``pre`` slots before."""
    return f"""
raw AS (
  SELECT name, t, sum(c) AS v FROM (
    SELECT 'ev.' || event_type || '.s' || CAST(user_id % 4 AS VARCHAR) AS name, CAST(epoch_us(ts) // 1000000 // {STEP} * {STEP} AS BIGINT) AS t, round(value * 100) AS c FROM events
  ) GROUP BY name, t
), names AS (SELECT name, row_number() OVER (ORDER BY name) AS sid FROM (SELECT DISTINCT name FROM raw)),
slots AS (SELECT unnest(range({FIRST - pre * STEP}, {LAST + 1}, {STEP})) AS t),
g AS (SELECT names.name, names.sid, slots.t, raw.v FROM names CROSS JOIN slots LEFT JOIN raw ON raw.name = names.name AND raw.t = slots.t)"""


def _sql(body: str, pre: int = 0, log: bool = False, more: str = "") -> str:
    """``body`` selects (name, t, v) and maybe inf from g."""
    v = "log10(abs(v))" if log else "v"
    return f"""WITH {_grid(pre)}{more}, out AS ({body})
SELECT name, CAST(t AS BIGINT) AS t, round(CASE WHEN isinf(v) THEN NULL ELSE {v} END, 6) AS v,
       CAST(coalesce(CASE WHEN isinf(v) THEN CASE WHEN v > 0 THEN 1 ELSE -1 END ELSE 0 END, 0) AS INTEGER) AS inf
FROM out WHERE t >= {FIRST}"""


AGG_SQL = {
    "average": "avg(v)",
    "count": "CAST(count(v) AS DOUBLE)",
    "diff": "2 * arg_min(v, {o}) FILTER (WHERE v IS NOT NULL) - sum(v)",
    "first": "arg_min(v, {o}) FILTER (WHERE v IS NOT NULL)",
    "last": "arg_max(v, {o}) FILTER (WHERE v IS NOT NULL)",
    "max": "max(v)",
    "median": "median(v)",
    "min": "min(v)",
    "multiply": "product(v)",
    "range": "max(v) - min(v)",
    "stddev": "stddev_pop(v)",
    "sum": "sum(v)",
}


def _agg(name: str, order: str = "t") -> str:
    return AGG_SQL[name].format(o=order)


def _mapped(fn: str, value: str) -> str:
    return _sql(f"SELECT '{fn}(' || name || ')' AS name, t, CAST({value} AS DOUBLE) AS v FROM g")


def _values() -> dict[str, tuple[Query, str]]:
    out = {}
    for fn, args, value in (
        ("absolute", (), "abs(v)"),
        ("drawAsInfinite", (), "CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN CAST('inf' AS DOUBLE) END"),
        ("invert", (), "CASE WHEN v = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / v END"),
        ("isNonNull", (), "CASE WHEN v IS NULL THEN 0 ELSE 1 END"),
        ("logarithm", (), "CASE WHEN v > 0 THEN ln(v) / ln(10) WHEN v = 0 THEN CAST('-inf' AS DOUBLE) END"),
        ("offset", (5,), "v + 5"),
        ("pow", (2,), "v * v"),
        ("removeAboveValue", (20000,), "CASE WHEN v <= 20000 THEN v END"),
        ("removeBelowValue", (9000,), "CASE WHEN v >= 9000 THEN v END"),
        ("scale", (3,), "v * 3"),
        ("scaleToSeconds", (60,), f"v * (60.0 / {STEP})"),
        ("squareRoot", (), "CASE WHEN v >= 0 THEN sqrt(v) END"),
    ):
        out[f"fn_{fn}"] = (_series(lambda fn=fn, args=args: call(fn, EV, *args)), _mapped(fn, value))
    return out


def _kept(test: str) -> str:
    return _sql(f"SELECT g.name, t, v FROM g WHERE name IN (SELECT name FROM g GROUP BY name HAVING {test})")


#: Thresholds are the aggregate of the series that comes so many-th from below: some series stay, some go, one is equal.
NTH = 5


def _threshold(spark: SparkSession, sf_dir: str, agg: str) -> float:
    s = path(EV).build(views.events(spark, sf_dir), Request(FIRST, LAST))
    return judged(s, agg).select("_a").orderBy("_a").limit(NTH).agg(F.max("_a")).first()[0]


def _nth(agg: str) -> str:
    return f"(SELECT max(a) FROM (SELECT {_agg(agg)} AS a FROM g GROUP BY name ORDER BY a LIMIT {NTH}))"


def _filter(make: Callable[[float], Expr], agg: str, op: str) -> tuple[Query, str]:
    query = lambda spark, sf_dir: _series(lambda: make(_threshold(spark, sf_dir, agg)))(spark, sf_dir)
    return query, _kept(f"{_agg(agg)} {op} {_nth(agg)}")


def _filters() -> dict[str, tuple[Query, str]]:
    out = {}
    for fn, agg, op in (
        ("averageAbove", "average", ">"),
        ("averageBelow", "average", "<"),
        ("currentAbove", "last", ">"),
        ("currentBelow", "last", "<"),
        ("maximumAbove", "max", ">"),
        ("maximumBelow", "max", "<"),
        ("minimumAbove", "min", ">"),
        ("minimumBelow", "min", "<"),
    ):
        out[f"fn_{fn}"] = _filter(lambda n, fn=fn: call(fn, EV, n), agg, op)
    out["fn_filterSeries"] = _filter(lambda n: call("filterSeries", EV, "median", ">=", n), "median", ">=")
    for word, op in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
        out[f"op_{word}"] = _filter(lambda n, word=word: call("filterSeries", EV, "sum", word, n), "sum", op)
    for fn, args, agg, way in (
        ("highest", (3,), "average", "DESC"),
        ("highestAverage", (4,), "average", "DESC"),
        ("highestCurrent", (4,), "last", "DESC"),
        ("highestMax", (5,), "max", "DESC"),
        ("lowest", (3, "sum"), "sum", "ASC"),
        ("lowestAverage", (4,), "average", "ASC"),
        ("lowestCurrent", (4,), "last", "ASC"),
    ):
        best = f"SELECT name FROM (SELECT name, any_value(sid) AS sid, {_agg(agg)} AS a FROM g GROUP BY name) WHERE a IS NOT NULL ORDER BY a {way}, sid LIMIT {args[0]}"
        out[f"fn_{fn}"] = (_series(lambda fn=fn, args=args: call(fn, EV, *args)), _sql(f"SELECT name, t, v FROM g WHERE name IN ({best})"))
    return out


def _windows() -> dict[str, tuple[Query, str]]:
    lag = "lag(v) OVER (PARTITION BY name ORDER BY t)"
    over = lambda fn, value: f"SELECT '{fn}(' || name || ')' AS name, t, {value} AS v FROM g"
    runs = "SELECT *, count(v) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING) AS r FROM g"
    fill = f"SELECT 'keepLastValue(' || name || ')' AS name, t, CASE WHEN v IS NOT NULL THEN v WHEN r > 0 AND sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY name, r) <= 3 THEN max(v) OVER (PARTITION BY name, r) END AS v FROM ({runs})"
    moving = lambda n: f"sum(v) OVER (PARTITION BY name ORDER BY t ROWS {n - 1} PRECEDING) / {n}"
    rises = f"SELECT *, {lag} AS p FROM g"
    return {
        "fn_derivative": (_series(lambda: call("derivative", EV)), _sql(over("derivative", f"v - {lag}"), 1)),
        "fn_nonNegativeDerivative": (_series(lambda: call("nonNegativeDerivative", EV)), _sql(f"SELECT 'nonNegativeDerivative(' || name || ')' AS name, t, CASE WHEN v >= p THEN v - p END AS v FROM ({rises})", 1)),
        "nonNegativeDerivative_wrap": (_series(lambda: call("nonNegativeDerivative", EV, 30000)), _sql(f"SELECT 'nonNegativeDerivative(' || name || ')' AS name, t, CASE WHEN v <= 30000 THEN CASE WHEN v >= p THEN v - p ELSE v + (30000 - p + 1) END END AS v FROM ({rises})", 1)),
        "fn_keepLastValue": (_series(lambda: call("keepLastValue", EV, 3)), _sql(fill, 1)),
        "fn_movingAverage": (_series(lambda: call("movingAverage", EV, 24)), _sql(over("movingAverage", moving(24)), 23)),
        "movingAverage_duration": (_series(lambda: call("movingAverage", EV, "1d")), _sql(over("movingAverage", moving(25)), 24)),
        "movingAverage_days": (_series(lambda: call("movingAverage", EV, "9d")), _sql(over("movingAverage", moving(217)), 216)),
        "movingAverage_long": (_series(lambda: call("movingAverage", EV, 300)), _sql(over("movingAverage", moving(300)), 299)),
        "fn_timeShift": (_series(lambda: call("timeShift", EV, "1d")), _sql("SELECT 'timeShift(' || name || ')' AS name, t + 86400 AS t, v FROM g WHERE t + 86400 < " + str(LAST + 1), 24)),
    }


def _combines() -> dict[str, tuple[Query, str]]:
    out = {}
    for agg in aggregators.NAMES:
        fn = f"{agg}Series"
        if agg not in ("count", "diff"):
            log = agg == "multiply"
            out[f"fn_{fn}"] = (_series(lambda fn=fn: call(fn, EV), log=log), _sql(f"SELECT '{fn}({EV})' AS name, t, {_agg(agg, 'sid')} AS v FROM g GROUP BY t", log=log))
    out["fn_countSeries"] = (_series(lambda: call("countSeries", "ev.click.*", "ev.view.s1")), _sql("SELECT 'countSeries(ev.view.s1)' AS name, t, CAST((SELECT count(*) FROM names WHERE name LIKE 'ev.click.%') + (SELECT count(*) FROM names WHERE name = 'ev.view.s1') AS DOUBLE) AS v FROM slots"))
    diff = "CASE WHEN count(v) FILTER (WHERE name LIKE 'ev.click.%') = (SELECT count(*) FROM names WHERE name LIKE 'ev.click.%') THEN sum(v) FILTER (WHERE name LIKE 'ev.click.%') - coalesce(sum(v) FILTER (WHERE name LIKE 'ev.view.%'), 0) END"
    out["fn_diffSeries"] = (_series(lambda: call("diffSeries", "ev.click.*", "ev.view.*")), _sql(f"SELECT 'diffSeries(ev.view.*)' AS name, t, {diff} AS v FROM g GROUP BY t"))
    out["fn_aggregate"] = (_series(lambda: call("aggregate", "ev.{click,view}.*", "max")), _sql("SELECT 'maxSeries(ev.{click,view}.*)' AS name, t, max(v) AS v FROM g WHERE regexp_matches(name, '^ev\\.(click|view)\\.') GROUP BY t"))
    out["fn_group"] = (_series(lambda: call("group", "ev.click.*", "ev.*.s0")), _sql("SELECT name, t, v FROM g WHERE name LIKE 'ev.click.%' UNION ALL SELECT name, t, v FROM g WHERE name LIKE '%.s0'"))
    return out


def _names() -> dict[str, tuple[Query, str]]:
    same = _sql("SELECT name, t, v FROM g")
    out = {
        "fn_alias": (_series(lambda: call("alias", EV, "total")), _sql("SELECT 'total' AS name, t, v FROM g")),
        "fn_aliasSub": (_series(lambda: call("aliasSub", EV, "ev", "x")), same),
        "fn_legendValue": (_series(lambda: call("legendValue", EV, "last")), same),
        "fn_color": (_series(lambda: call("color", EV, "red")), same),
        "fn_lineWidth": (_series(lambda: call("lineWidth", EV, 2)), same),
        "fn_consolidateBy": (_series(lambda: call("consolidateBy", EV, "max"), 100), _merged("max")),
    }
    out |= {f"agg_{agg}": (_series(lambda agg=agg: call("consolidateBy", EV, agg), 100, log=agg == "multiply"), _merged(agg, agg == "multiply")) for agg in aggregators.NAMES}
    return out


def _merged(agg: str, log: bool = False) -> str:
    merged = STEP * 8  # 2,591,999 seconds in 100 points: eight slots each, aligned to 1601
    at = f"t - (t + 11644473600) % {merged}"
    return _sql(f"SELECT name, {at} AS t, {_agg(agg)} AS v FROM g GROUP BY name, {at}", log=log).replace(f"WHERE t >= {FIRST}", "")


def _nested() -> dict[str, tuple[Query, str]]:
    avg6 = "SELECT name, any_value(sid) AS sid, max(v) AS a FROM (SELECT name, sid, t, sum(v) OVER (PARTITION BY name ORDER BY t ROWS 5 PRECEDING) / 6 AS v FROM g) WHERE t >= {f} GROUP BY name".format(f=FIRST)
    best = f"SELECT name FROM ({avg6}) WHERE a IS NOT NULL ORDER BY a DESC, sid LIMIT 3"
    twice = "SELECT 'sumSeries(ev.click.s0)' AS name, t, sum(v) AS v FROM (SELECT t, v FROM g UNION ALL SELECT t, v FROM g WHERE name = 'ev.click.s0') GROUP BY t"
    day = "SELECT 'diffSeries(ev.click.s0)' AS name, a.t, a.v - coalesce(b.v, 0) AS v FROM g a LEFT JOIN g b ON a.name = b.name AND a.t = b.t + 86400 WHERE a.name = 'ev.click.s0'"
    step = "SELECT name, t, v - lag(v) OVER (PARTITION BY name ORDER BY t) AS v FROM g"
    both = f"SELECT 'derivative(' || name || ')' AS name, t, v FROM ({step}) UNION ALL SELECT 'derivative(timeShift(' || name || '))' AS name, t + 86400 AS t, v FROM ({step}) WHERE t + 86400 < {LAST + 1}"
    infinite = "SELECT name, sid, t, CASE WHEN v > 0 THEN CAST('inf' AS DOUBLE) WHEN v = 0 THEN 0 END AS v FROM g"
    minus = f"SELECT name, t, CASE WHEN isinf(v) AND isinf(p) THEN NULL ELSE v - p END AS v FROM (SELECT name, t, v, lag(v) OVER (PARTITION BY name ORDER BY t) AS p FROM ({infinite}))"
    ups = f"SELECT t, count(v) AS n, count(v) FILTER (isinf(v)) AS k FROM ({infinite}) GROUP BY t"
    return {
        "nested_infinite_derivative": (_series(lambda: call("derivative", call("drawAsInfinite", EV))), _sql(f"SELECT 'derivative(drawAsInfinite(' || name || '))' AS name, t, v FROM ({minus})", 1)),
        "nested_infinite_scale": (_series(lambda: call("scale", call("drawAsInfinite", EV), 0)), _sql(f"SELECT 'scale(drawAsInfinite(' || name || '))' AS name, t, CASE WHEN isinf(v) THEN NULL ELSE v * 0 END AS v FROM ({infinite})")),
        "nested_infinite_range": (_series(lambda: call("rangeSeries", call("drawAsInfinite", EV))), _sql(f"SELECT 'rangeSeries({EV})' AS name, t, CASE WHEN n = 0 OR k = n THEN NULL WHEN k > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS v FROM ({ups})")),
        "nested_infinite_moving": (_series(lambda: call("movingAverage", call("drawAsInfinite", EV), 100)), _sql(f"SELECT 'movingAverage(drawAsInfinite(' || name || '))' AS name, t, sum(v) OVER (PARTITION BY name ORDER BY t ROWS 99 PRECEDING) / 100 AS v FROM ({infinite})", 99)),
        "nested_top_of_moving": (_series(lambda: call("highestMax", call("movingAverage", EV, 6), 3)), _sql(f"SELECT 'movingAverage(' || name || ')' AS name, t, sum(v) OVER (PARTITION BY name ORDER BY t ROWS 5 PRECEDING) / 6 AS v FROM g WHERE name IN ({best})", 5)),
        "nested_sum_counts_twice": (_series(lambda: call("sum", EV, "ev.click.s0")), _sql(twice)),
        "nested_day_before": (_series(lambda: call("diffSeries", "ev.click.s0", call("timeShift", "ev.click.s0", "1d"))), _sql(day, 24)),
        "nested_two_copies": (_series(lambda: call("derivative", call("group", EV, call("timeShift", EV, "1d")))), _sql(both, 25)),
    }


_PARTS = "names AS (SELECT p_partkey AS id, 'part.' || regexp_replace(p_brand, '[^A-Za-z0-9_.-]', '_', 'g') || '.' || replace(regexp_replace(lower(p_type), '[^A-Za-z0-9_.-]', '_', 'g'), '_', '.') || '.p' || CAST(p_partkey AS VARCHAR) AS name FROM part)"
_BRANCHES = "branches AS (SELECT DISTINCT array_to_string(list_slice(s, 1, k), '.') AS name FROM (SELECT s, unnest(range(1, len(s))) AS k FROM (SELECT string_split(name, '.') AS s FROM names)))"


def _finds() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}
    for key, pattern, test in (
        ("inside", "part.Brand_*2.*m*l*.p*1*", "regexp_matches(name, '^part\\.Brand_[^.]*2\\.[^.]*m[^.]*l[^.]*\\.p[^.]*1[^.]*$')"),
        ("star", "part.*.small.*", "regexp_matches(name, '^part\\.[^.]*\\.small\\.[^.]*$')"),
        ("doublestar", "**.small.**", "regexp_matches(name, '\\.small\\.')"),
        ("charclass", "part.Brand_[1-3].*.p*[05]", "regexp_matches(name, '^part\\.Brand_[1-3]\\.[^.]*\\.p[^.]*[05]$')"),
        ("choice", "part.Brand_{2,17}.{small,e*}.*", "regexp_matches(name, '^part\\.Brand_(2|17)\\.(small|e[^.]*)\\.[^.]*$')"),
        ("all", "**", "true"),
    ):
        out[f"find_{key}"] = (lambda spark, sf_dir, pattern=pattern: catalog.find(views.part_names(spark, sf_dir), pattern), f"WITH {_PARTS} SELECT id, name FROM names WHERE {test}")
    first = lambda df: df.orderBy("id").select("name").first()["name"]
    out["find_exact"] = (lambda spark, sf_dir: (lambda names: catalog.find(names, first(names)))(views.part_names(spark, sf_dir)), f"WITH {_PARTS} SELECT id, name FROM names WHERE name = (SELECT name FROM names ORDER BY id LIMIT 1)")
    out["metrics_find_leaves"] = (lambda spark, sf_dir: catalog.browse_paths(views.part_names(spark, sf_dir), "part.*.s*"), f"WITH {_PARTS}, {_BRANCHES}, hits AS (SELECT name AS path, false AS is_leaf FROM branches UNION ALL SELECT name, true FROM names) SELECT path, is_leaf FROM hits WHERE regexp_matches(path, '^part\\.[^.]*\\.s[^.]*$')")
    out["find_branches"] = (lambda spark, sf_dir: catalog.find_branches(views.part_names(spark, sf_dir), "part.*.*"), f"WITH {_PARTS}, {_BRANCHES} SELECT name FROM branches WHERE regexp_matches(name, '^part\\.[^.]*\\.[^.]*$')")
    browse = f"WITH {_PARTS}, {_BRANCHES}, hits AS (SELECT name AS path, true AS expandable FROM branches UNION ALL SELECT name, false FROM names) SELECT path, string_split(path, '.')[-1] AS text, expandable FROM hits WHERE regexp_matches(path, '^part\\.[^.]*\\.[^.]*$')"
    out["metrics_find"] = (lambda spark, sf_dir: catalog.browse(views.part_names(spark, sf_dir), "part.*.*"), browse)
    out["metrics_index"] = (lambda spark, sf_dir: catalog.index(views.part_names(spark, sf_dir)), f"WITH {_PARTS} SELECT name FROM names")
    return out


RULES = [catalog.Rule(r"^ev\.error\.", 0, 60, "int32"), catalog.Rule(r"^ev\.(click|view)\.", 7 * 86400, 3600, "float64"), catalog.Rule(".*", 30 * 86400, 60, "int32")]
_WRITES = "w AS (SELECT 'ev.' || event_type || '.u' || CAST(user_id AS VARCHAR) AS name, round(value * 100) AS v, epoch_us(ts) // 1000000 AS t, event_id AS seq, event_type AS kind FROM events)"
_STORED = f"""{_WRITES}, slotted AS (
  SELECT name, kind, seq, CAST(CASE WHEN kind IN ('click', 'view') THEN t - t % 3600 ELSE t - t % 60 END AS BIGINT) AS t,
         CASE WHEN kind IN ('click', 'view') THEN v ELSE sign(v) * floor(least(abs(v), 2147483647)) END AS v,
         CASE WHEN kind IN ('click', 'view') THEN 7 ELSE 30 END * 86400 AS retention
  FROM w WHERE kind <> 'error'
), latest AS (SELECT name, any_value(retention) AS retention, max(t) AS last_t FROM slotted GROUP BY name),
stored AS (
  SELECT s.name, s.t, arg_max(s.v, s.seq) AS v FROM slotted s JOIN latest l ON s.name = l.name WHERE s.t > l.last_t - l.retention GROUP BY s.name, s.t
)"""


def _empty(spark: SparkSession) -> Store:
    return Store(spark.createDataFrame([], "id long, name string, n_segs int, type string, retention long, step long, creation long, last_t long"), spark.createDataFrame([], "id long, t long, v double"))


def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    return ingest.merge(_empty(spark), views.event_lines(spark, sf_dir), RULES, LAST)


def _stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(spark, sf_dir)
    return store.samples.join(store.catalog.select("id", "name"), "id").select("name", "t", "v")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The writes with even numbers, and all of them: what comes twice stays the same."""
    lines = views.event_lines(spark, sf_dir)
    return lines.where("seq % 2 = 0"), lines


#: The same in SQL: the store after the first half, and each slot's last write in the second batch.
_TWICE = f"""{_STORED}, first_latest AS (SELECT name, max(t) AS last_t FROM slotted WHERE seq % 2 = 0 GROUP BY name),
first_stored AS (
  SELECT s.name, s.t, arg_max(s.v, s.seq) AS v FROM slotted s JOIN first_latest l ON s.name = l.name WHERE seq % 2 = 0 AND s.t > l.last_t - s.retention GROUP BY s.name, s.t
), again AS (
  SELECT s.name, s.t, arg_max(s.v, s.seq) AS v, any_value(s.t <= l.last_t - l.retention) AS old FROM slotted s JOIN latest l ON s.name = l.name GROUP BY s.name, s.t
)"""


def _filled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, again = _halves(spark, sf_dir)
    store = ingest.merge(ingest.merge(_empty(spark), first, RULES, LAST), again.where("seq % 2 = 1"), RULES, LAST)
    return store.samples.join(store.catalog.select("id", "name"), "id").select("name", "t", "v")


def _filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, again = _halves(spark, sf_dir)
    return ingest.counts(ingest.merge(_empty(spark), first, RULES, LAST), again, RULES, LAST)


def _long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.event_lines(spark, sf_dir).withColumn("name", F.concat("name", F.lit("."), F.repeat(F.lit("x"), 120)))
    store = ingest.merge(_empty(spark), lines, RULES, LAST)
    return store.samples.groupBy("id").agg(F.count("*").alias("n")).join(store.catalog, "id").select("name", "n")


def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(spark, sf_dir)
    n = store.samples.groupBy("id").agg(F.count("*").alias("n"), F.min("t").alias("oldest"))
    return store.catalog.join(n, "id").select("name", "type", "retention", "step", "last_t", "oldest", "n")


def _ingest() -> dict[str, tuple[Query, str]]:
    lines = lambda spark, sf_dir: views.event_lines(spark, sf_dir)
    out: dict[str, tuple[Query, str]] = {
        "ingest_last_write_wins": (_stored_rows, f"WITH {_STORED} SELECT name, t, v FROM stored"),
        "ingest_retention": (_retention, f"WITH {_STORED} SELECT s.name, CASE WHEN any_value(l.retention) = 604800 THEN 'float64' ELSE 'int32' END AS type, CAST(any_value(l.retention) AS BIGINT) AS retention, CAST(CASE WHEN any_value(l.retention) = 604800 THEN 3600 ELSE 60 END AS BIGINT) AS step, any_value(l.last_t) AS last_t, min(s.t) AS oldest, count(*) AS n FROM stored s JOIN latest l ON s.name = l.name GROUP BY s.name"),
        "ingest_counts": (lambda spark, sf_dir: ingest.counts(_empty(spark), lines(spark, sf_dir), RULES, LAST), f"WITH {_STORED}, a AS (SELECT count(*) AS n FROM stored), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT name, t FROM slotted)) SELECT CAST(a.n AS BIGINT) AS added, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS same, CAST(b.n - a.n AS BIGINT) AS old FROM a, b"),
        "ingest_merge": (_filled_rows, f"WITH {_STORED}, b AS (SELECT s.name, s.t, arg_max(s.v, s.seq % 2 * 1000000000000 + s.seq) AS v FROM slotted s JOIN latest l ON s.name = l.name WHERE s.t > l.last_t - l.retention GROUP BY s.name, s.t) SELECT name, t, v FROM b"),
        "ingest_counts_filled": (
            _filled_counts,
            f"WITH {_TWICE} SELECT CAST(count(*) FILTER (NOT old AND f.v IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (NOT old AND f.v <> a.v) AS BIGINT) AS changed, CAST(count(*) FILTER (NOT old AND f.v = a.v) AS BIGINT) AS same, CAST(count(*) FILTER (old) AS BIGINT) AS old FROM again a LEFT JOIN first_stored f ON a.name = f.name AND a.t = f.t",
        ),
        "ingest_long_names": (
            _long_names,
            f"WITH {_STORED}, c AS (SELECT substr(name || '.' || repeat('x', 120), 1, 127) AS name, t FROM stored) SELECT name, count(*) AS n FROM c GROUP BY name",
        ),
        "ingest_rules": (
            lambda spark, sf_dir: lines(spark, sf_dir).select("name").distinct().withColumn("s", catalog.settings(F.col("name"), RULES)).where("s is not null").select("name", "s.type", "s.retention", "s.step"),
            f"WITH {_WRITES} SELECT DISTINCT name, CASE WHEN kind IN ('click', 'view') THEN 'float64' ELSE 'int32' END AS type, CAST(CASE WHEN kind IN ('click', 'view') THEN 604800 ELSE 2592000 END AS BIGINT) AS retention, CAST(CASE WHEN kind IN ('click', 'view') THEN 3600 ELSE 60 END AS BIGINT) AS step FROM w WHERE kind <> 'error'",
        ),
        "ingest_expire": (
            lambda spark, sf_dir: catalog.expire(_ingested(spark, sf_dir).catalog.withColumn("retention", F.lit(3600).cast("long")), LAST).select("name", "last_t"),
            f"WITH {_STORED} SELECT name, last_t FROM latest WHERE {LAST} < last_t + 7200",
        ),
        "carbon_write": (lambda spark, sf_dir: carbon.format_lines(lines(spark, sf_dir)), f"WITH {_WRITES} SELECT name || ' ' || CAST(CAST(v AS BIGINT) AS VARCHAR) || ' ' || CAST(t AS VARCHAR) AS value FROM w WHERE v IS NOT NULL"),
        "carbon_parse": (lambda spark, sf_dir: carbon.parse_lines(carbon.format_lines(lines(spark, sf_dir))).select("name", "v", "t", "malformed"), f"WITH {_WRITES} SELECT name, v, CAST(t AS BIGINT) AS t, false AS malformed FROM w WHERE v IS NOT NULL"),
        "analyze_deltas": (
            lambda spark, sf_dir: dump.analyze(lines(spark, sf_dir).select("name", "t").distinct(), "name"),
            f"WITH {_WRITES}, u AS (SELECT DISTINCT name, t FROM w), d AS (SELECT name, t, t - lag(t) OVER (PARTITION BY name ORDER BY t) AS d FROM u), dd AS (SELECT d - lag(d) OVER (PARTITION BY name ORDER BY t) AS dd FROM d) SELECT CAST(CASE WHEN dd = 0 THEN 0 ELSE sign(dd) * (floor(log2(abs(dd))) + 1) END AS BIGINT) AS bits, count(*) AS n FROM dd WHERE dd IS NOT NULL GROUP BY 1",
        ),
    }
    for kind, most in (("float32", 0), ("float64", 0), ("int8", 127), ("int16", 32767), ("int32", 2147483647)):
        made = {"float32": "CAST(CAST(x AS FLOAT) AS DOUBLE)", "float64": "x"}.get(kind, f"sign(x) * floor(least(abs(x), {most}))")
        out[f"quantize_{kind}"] = (
            lambda spark, sf_dir, kind=kind: views.table(spark, sf_dir, "orders").select("o_orderkey", catalog.quantize(F.col("o_totalprice") - 100000, F.lit(kind)).alias("v")),
            f"SELECT o_orderkey, {made} AS v FROM (SELECT o_orderkey, o_totalprice - 100000 AS x FROM orders)",
        )
    return out


_DAYS = "d AS (SELECT 'li.' || l_returnflag || '.' || l_linestatus AS name, CAST(epoch_us(l_shipdate) // 1000000 // 86400 * 86400 AS BIGINT) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _dumps() -> dict[str, tuple[Query, str]]:
    def records(spark, sf_dir):
        r = dump.dump(views.lineitem(spark, sf_dir), "li.**")
        return r.select("name", "type", "interval", "first", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"))

    def loaded(spark, sf_dir):
        s = dump.load(dump.dump(views.lineitem(spark, sf_dir)))
        return s.samples.join(s.catalog.select("id", "name"), "id").select("name", "t", "v")

    def json_lines(spark, sf_dir):
        return as_json(render(views.lineitem(spark, sf_dir), ["li.R.*", call("sumSeries", "li.*.*")], LI_FIRST, LI_LAST)).select("pos", "json")

    def record_rows(spark, sf_dir):
        r = as_records(views.lineitem(spark, sf_dir), ["li.R.*", "li.*.*"], LI_FIRST, LI_LAST)
        return r.select("name", "pathExpression", "start", "end", "step", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"))

    def erased(spark, sf_dir):
        s = views.lineitem(spark, sf_dir)
        left = erase(s, catalog.find(s.catalog, "li.R.*").select("id"))
        return left.samples.join(left.catalog.select("id", "name"), "id").select("name", "t", "v")

    def reconfigured(spark, sf_dir):
        s = views.lineitem(spark, sf_dir)
        s = Store(s.catalog.withColumn("retention", F.lit(86400 * 365).cast("long")), s.samples)
        ids = catalog.find(s.catalog, "li.*.F").select("id")
        change = ids.select("id", F.lit("float64").alias("type"), F.lit(86400 * 365).cast("long").alias("retention"), F.when(F.col("id") % 2 == 0, 3600).otherwise(86400).cast("long").alias("step"))
        s = reconfigure(s, change)
        n = s.samples.groupBy("id").agg(F.count("*").alias("n"))
        return s.catalog.join(n, "id", "left").select("name", "step", "retention", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    dense = f"WITH {_DAYS}, slots AS (SELECT unnest(range({LI_FIRST}, {LI_LAST + 1}, 86400)) AS t), g AS (SELECT n.name, s.t, d.v FROM (SELECT DISTINCT name FROM d) n CROSS JOIN slots s LEFT JOIN d ON d.name = n.name AND d.t = s.t)"
    return {
        "dump": (records, f"WITH {_DAYS} SELECT name, 'float64' AS type, CAST(86400 AS BIGINT) AS interval, min(t) AS first, CAST((max(t) - min(t)) // 86400 + 1 AS INTEGER) AS n, sum(v) AS total FROM d GROUP BY name"),
        "load": (loaded, f"WITH {_DAYS} SELECT name, t, v FROM d"),
        "erase": (erased, f"WITH {_DAYS} SELECT name, t, v FROM d WHERE name NOT LIKE 'li.R.%'"),
        "reconfigure": (
            reconfigured,
            f"WITH {_DAYS}, n AS (SELECT name, count(*) AS n, row_number() OVER (ORDER BY name) % 2 = 0 AND name LIKE '%.F' AS anew FROM d GROUP BY name) SELECT name, CAST(CASE WHEN anew THEN 3600 ELSE 86400 END AS BIGINT) AS step, CAST(31536000 AS BIGINT) AS retention, CAST(CASE WHEN anew THEN 0 ELSE n END AS BIGINT) AS n FROM n",
        ),
        "render_json": (json_lines, f"{dense}, s AS (SELECT 0 AS pos, name, t, v FROM g WHERE name LIKE 'li.R.%' UNION ALL SELECT 1, 'sumSeries(li.*.*)', t, sum(v) FROM g GROUP BY t) SELECT CAST(pos AS INTEGER) AS pos, '{{\"target\":\"' || name || '\",\"datapoints\":[' || string_agg('[' || coalesce(CAST(v AS VARCHAR), 'null') || ',' || CAST(t AS VARCHAR) || ']', ',' ORDER BY t) || ']}}' AS json FROM s GROUP BY pos, name"),
        "render_records": (record_rows, f"{dense} SELECT name, CASE WHEN name LIKE 'li.R.%' THEN 'li.R.*' ELSE 'li.*.*' END AS pathExpression, CAST(min(t) AS BIGINT) AS start, CAST(max(t) + 86400 AS BIGINT) AS \"end\", CAST(86400 AS BIGINT) AS step, CAST(count(*) AS INTEGER) AS n, coalesce(sum(v), 0) AS total FROM g GROUP BY name"),
        "catalog_summary": (lambda spark, sf_dir: (lambda s: catalog.summary(s.catalog, s.samples))(views.lineitem(spark, sf_dir)), f"WITH {_DAYS} SELECT 'float64' AS type, count(DISTINCT name) AS series, count(*) AS samples FROM d"),
    }


#: All days that the line items can have.
LI_FIRST, LI_LAST = 757382400, 1072915199


def _all() -> dict[str, tuple[Query, str]]:
    leaf = {"path_all": (_series(lambda: path(EV)), _sql("SELECT name, t, v FROM g")), "path_exact": (_series(lambda: path("ev.click.s1")), _sql("SELECT name, t, v FROM g WHERE name = 'ev.click.s1'"))}
    return leaf | _values() | _filters() | _windows() | _combines() | _names() | _nested() | _finds() | _ingest() | _dumps()


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three of the moving averages of all event series."""
    return queries()["nested_top_of_moving"](spark, sf_dir)

"""The functions by the names that queries use, with their published descriptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chronoloom.functions import aggregators
from chronoloom.operators import combine, filters, leaf, naming, values, windows

path = leaf.path


@dataclass(frozen=True)
class Arg:
    name: str
    type: str
    require: bool = True
    multiple: bool = False


@dataclass(frozen=True)
class Function:
    name: str
    group: str
    call: object
    args: tuple[Arg, ...]
    aliases: tuple[str, ...] = field(default=())


_Q = Arg("query", "pathOrFunc")
_N = Arg("n", "num")
_MANY = (_Q, Arg("query", "pathOrFunc", False, True))


def _table() -> list[Function]:
    f = lambda group, name, call, *args, aliases=(): Function(name, group, call, args, aliases)
    agg, factor = Arg("aggFunc", "aggFunc"), Arg("factor", "num")
    out = [f("Combine", n, getattr(combine, n), *_MANY, aliases=a) for n, a in (("averageSeries", ("avg",)), ("countSeries", ()), ("diffSeries", ()), ("firstSeries", ()), ("lastSeries", ()), ("maxSeries", ()), ("medianSeries", ()), ("minSeries", ()), ("multiplySeries", ()), ("rangeSeries", ()), ("stddevSeries", ()), ("sumSeries", ("sum",)), ("group", ()))]
    out.append(f("Combine", "aggregate", combine.aggregate_series, _Q, agg))
    out.append(f("Filter Series", "filterSeries", filters.filterSeries, _Q, agg, Arg("operator", "operator"), _N))
    out += [f("Filter Series", n, getattr(filters, n), _Q, _N) for n in ("averageAbove", "averageBelow", "currentAbove", "currentBelow", "maximumAbove", "maximumBelow", "minimumAbove", "minimumBelow", "highestAverage", "highestCurrent", "highestMax", "lowestAverage", "lowestCurrent")]
    out += [f("Filter Series", n, getattr(filters, n), _Q, Arg("n", "num", False), Arg("aggFunc", "aggFunc", False)) for n in ("highest", "lowest")]
    out += [f("Transform", n, getattr(values, n), _Q) for n in ("absolute", "drawAsInfinite", "invert", "isNonNull", "squareRoot")]
    out += [f("Transform", n, getattr(values, n), _Q, factor) for n in ("offset", "pow", "scale")]
    out.append(f("Transform", "logarithm", values.logarithm, _Q, Arg("base", "num", False)))
    out.append(f("Transform", "scaleToSeconds", values.scaleToSeconds, _Q, Arg("seconds", "num")))
    out += [f("Filter Data", n, getattr(values, n), _Q, _N) for n in ("removeAboveValue", "removeBelowValue")]
    out.append(f("Transform", "derivative", windows.derivative, _Q))
    out.append(f("Transform", "nonNegativeDerivative", windows.nonNegativeDerivative, _Q, Arg("maxValue", "num", False)))
    out.append(f("Transform", "keepLastValue", windows.keepLastValue, _Q, Arg("limit", "num", False)))
    out.append(f("Transform", "timeShift", windows.timeShift, _Q, Arg("timeShift", "string")))
    out.append(f("Calculate", "movingAverage", windows.movingAverage, _Q, Arg("windowSize", "numOrString"), Arg("xFilesFactor", "num", False)))
    out.append(f("Special", "consolidateBy", naming.consolidateBy, _Q, agg))
    out.append(f("Alias", "alias", naming.alias, _Q, Arg("name", "string")))
    out.append(f("Alias", "aliasSub", naming.aliasSub, _Q, Arg("search", "string"), Arg("replace", "string")))
    out.append(f("Graph", "legendValue", naming.legendValue, _Q, Arg("valueTypes", "string", False, True)))
    out.append(f("Graph", "color", naming.color, _Q, Arg("color", "string")))
    out.append(f("Graph", "lineWidth", naming.lineWidth, _Q, Arg("width", "num")))
    return sorted(out, key=lambda x: x.name)


FUNCTIONS: dict[str, Function] = {f.name: f for f in _table()}
FUNCTIONS |= {a: f for f in list(FUNCTIONS.values()) for a in f.aliases}


def register(name: str, group: str, call: Callable, *args: Arg, aliases: tuple[str, ...] = ()) -> None:
    """Adds a function of one's own, which takes paths or expressions and gives an ``Expr``."""
    taken = {name, *aliases} & FUNCTIONS.keys()
    if taken:
        raise ValueError(f"there is a function {', '.join(sorted(taken))}")
    FUNCTIONS.update(dict.fromkeys((name, *aliases), Function(name, group, call, args, aliases)))


def call(name: str, *args):
    """The function of that name or alias, applied."""
    return FUNCTIONS[name].call(*args)


def function_index(spark: SparkSession) -> DataFrame:
    """``(name, aliases, grp, pos, arg, type, required, multiple, choices)``: a row per argument."""
    rows = []
    for f in sorted({id(f): f for f in FUNCTIONS.values()}.values(), key=lambda f: f.name):
        for i, a in enumerate(f.args):
            choices = {"aggFunc": ",".join(aggregators.NAMES), "operator": "eq,ne,gt,ge,lt,le"}.get(a.type)
            rows.append((f.name, ",".join(f.aliases) or None, f.group, i, a.name, "enum" if choices else a.type, a.require, a.multiple, choices))
    return spark.createDataFrame(rows, "name string, aliases string, grp string, pos int, arg string, type string, required boolean, multiple boolean, choices string")

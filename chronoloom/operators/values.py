"""Functions of one sample at a time: narrow projections within codegen."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.operators.leaf import as_expr
from chronoloom.operators.series import Expr, Request, SeriesSet, Store, dense, derived, finite

_INF = float("inf")


def _map(function: str, q: str | Expr, value: Column, on_nulls: bool = False) -> Expr:
    arg = as_expr(q)

    def build(store: Store, req: Request) -> SeriesSet:
        s = arg.build(store, req)
        s = dense(s) if on_nulls else s
        out = s.values(finite(value)).renamed(derived(function))
        return out if out.full else replace(out, samples=out.samples.where("v is not null"))

    return Expr(build, arg.target, arg.method)


def absolute(q: str | Expr) -> Expr:
    return _map("absolute", q, F.abs("v"))


def drawAsInfinite(q: str | Expr) -> Expr:
    """Zero stays zero, positive becomes infinite, negative goes missing."""
    return _map("drawAsInfinite", q, F.when(F.col("v") == 0, F.lit(0.0)).when(F.col("v") > 0, F.lit(_INF)))


def invert(q: str | Expr) -> Expr:
    """1 / v; zero becomes infinite with the sign of the zero."""
    v = F.col("v")
    negative_zero = F.lit(-0.0)
    at_zero = F.when(v.cast("string") == negative_zero.cast("string"), F.lit(-_INF)).otherwise(F.lit(_INF))
    return _map("invert", q, F.when(v == 0, at_zero).otherwise(F.try_divide(F.lit(1.0), v)))


def isNonNull(q: str | Expr) -> Expr:
    """1 where there is a value, 0 where it is missing."""
    return _map("isNonNull", q, F.col("v").isNotNull().cast("double"), on_nulls=True)


def logarithm(q: str | Expr, base: float = 10) -> Expr:
    """Zero becomes minus infinity, negative goes missing."""
    v = F.col("v")
    return _map("logarithm", q, F.when(v > 0, F.ln(v) / F.lit(math.log(base)) if base > 0 and base != 1 else F.lit(None)).when(v == 0, F.lit(-_INF)).cast("double"))


def offset(q: str | Expr, factor: float) -> Expr:
    return _map("offset", q, F.col("v") + F.lit(float(factor)))


def pow(q: str | Expr, factor: float) -> Expr:
    return _map("pow", q, F.pow("v", F.lit(float(factor))))


def removeAboveValue(q: str | Expr, n: float) -> Expr:
    return _map("removeAboveValue", q, F.when(F.col("v") <= F.lit(float(n)), F.col("v")))


def removeBelowValue(q: str | Expr, n: float) -> Expr:
    return _map("removeBelowValue", q, F.when(F.col("v") >= F.lit(float(n)), F.col("v")))


def scale(q: str | Expr, factor: float) -> Expr:
    return _map("scale", q, F.col("v") * F.lit(float(factor)))


def scaleToSeconds(q: str | Expr, seconds: float) -> Expr:
    return _map("scaleToSeconds", q, F.col("v") * (F.lit(float(seconds)) / F.col("step")))


def squareRoot(q: str | Expr) -> Expr:
    return _map("squareRoot", q, F.when(F.col("v") >= 0, F.sqrt("v")))

"""Where series come from: paths over a store, and unions of arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.globs import matches
from chronoloom.operators.series import Expr, Request, SeriesSet, Store


def path(pattern: str) -> Expr:
    """The series whose names fit; one without samples in the window is all null.

    The time range and the pattern's conditions are pushed into the scans. Samples
    at or before a series' last time less its retention are not visible.
    """

    def build(store: Store, req: Request) -> SeriesSet:
        step = F.col("step")
        fits = store.catalog.where(matches(pattern, F.col("name"), F.col("n_segs")))
        heads = fits.select(
            F.col("id").cast("string").alias("skey"),
            F.lit(0).alias("arg"),
            F.col("id").alias("sid"),
            step,
            req.lo(step).alias("lo"),
            req.hi(step).alias("hi"),
            F.lit(pattern).alias("target"),
            "name",
            F.when(F.col("retention") > 0, F.col("last_t") - F.col("retention")).alias("oldest"),
        )
        # Constant bounds reach the scan; the exact ones depend on each series' step.
        low = req.first - req.pretime - (req.pre + 1) * store.longest_step
        rows = store.samples.where(F.col("t").between(low, req.last))
        if "day" in rows.columns:
            rows = rows.where(F.col("day").between(low // 86400, req.last // 86400))
        at = heads.select(F.col("sid").alias("id"), "skey", "step", "lo", "hi", "oldest")
        rows = rows.join(at, "id").where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")) & (F.col("oldest").isNull() | (F.col("t") > F.col("oldest"))))
        return SeriesSet(heads.drop("oldest"), rows.where("v is not null").select("skey", "step", "t", "v"))

    return Expr(build, pattern)


def as_expr(x: str | Expr) -> Expr:
    return path(x) if isinstance(x, str) else x


def union(args: list[Expr], store: Store, req: Request) -> SeriesSet:
    """All series of all arguments, keyed by argument so that none is mistaken for
    another one of the same metric."""
    heads, samples, sets = None, None, [arg.build(store, req) for arg in args]
    for i, s in enumerate(sets):
        if len(args) > 1:
            key = F.concat(F.lit(f"{i}:"), F.col("skey"))
            s = SeriesSet(s.heads.withColumns({"skey": key, "arg": F.lit(i)}), s.samples.select(key.alias("skey"), "step", "t", "v"))
        heads = s.heads if heads is None else heads.unionByName(s.heads)
        samples = s.samples if samples is None else samples.unionByName(s.samples)
    return SeriesSet(heads, samples, all(s.full for s in sets))


def group(*queries: str | Expr) -> Expr:
    """The series of all arguments, unchanged."""
    args = [as_expr(q) for q in queries]
    return Expr(lambda store, req: union(args, store, req), args[-1].target, args[-1].method)

"""Names, patterns, feed lines, stores, streams."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.globs import matches, regex
from chronoloom.functions.times import EPOCH_SHIFT, align, duration, request_time
from chronoloom.operators.series import Store
from chronoloom.plans import library
from chronoloom.plans.library import FUNCTIONS, call, function_index
from chronoloom.plans.render import as_json, render
from chronoloom.sources import carbon, catalog, dump
from chronoloom.sources.catalog import Rule
from chronoloom.sources.store import compact, erase, open_store, reconfigure, write_store
from chronoloom.streaming import ingest

CATALOG = "id long, name string, n_segs int, type string, retention long, step long, creation long, last_t long"


def names(spark, values):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(values)], "id long, name string").withColumn("n_segs", catalog.n_segs(F.col("name")))


def empty(spark):
    return Store(spark.createDataFrame([], CATALOG), spark.createDataFrame([], "id long, t long, v double"))


FOUR = ["a.z", "a.b.m.z", "a.m.y.z", "a.b.m.y.z"]
FINDS = [
    (["a.bd.c"], "a.b{,d}.c", {1}),
    (["a", "b", "ab", "ad", "abc", "abd"], "a{b,c}", {3}),
    (["a", "b", "ab", "ad", "abc", "abd"], "{a,c}b", {3}),
    (["a", "b", "ab", "ad", "abc", "abd"], "{a,b}", {1, 2}),
    (["a", "b", "ab", "ad", "abc", "abd"], "{a[bd],b}", {2, 3, 4}),
    (FOUR, "*.z.m.*", set()),
    (FOUR, "a*", set()),
    (FOUR, "a*.z", {1}),
    (FOUR, "a.b*", set()),
    (FOUR, "a.m.y.z", {3}),
    (FOUR, "a.*.*.z", {2, 3}),
    (FOUR, "**", {1, 2, 3, 4}),
    (FOUR, "a.b.**", {2, 4}),
    (FOUR, "**.y.z", {3, 4}),
    (FOUR, "a.**.z", {1, 2, 3, 4}),
    (FOUR, "a.**.m.**.z", {2, 3, 4}),
    (FOUR, "*.**", {1, 2, 3, 4}),
    (FOUR, "a.{b", set()),
    (FOUR, "", {1, 2, 3, 4}),
]


@pytest.mark.parametrize("have,pattern,want", FINDS)
def test_find(spark, have, pattern, want):
    assert {r.id for r in catalog.find(names(spark, have), pattern).collect()} == want


def test_pattern_classes():
    assert re.match(regex("a[62-41]"), "a3") and re.match(regex("a[62-41]"), "a6") and not re.match(regex("a[62-41]"), "a5")
    assert re.match(regex("a[9-7]"), "a9") and re.match(regex("a[9-7]"), "a7") and not re.match(regex("a[9-7]"), "a8")
    assert re.match(regex("a[-x]"), "a-") and re.match(regex("a**b.c"), "axxb.c") and not re.match(regex("a**b.c"), "a.b.c")
    for bad in ("a..b", "{a}", "a{b.c,d}", "a b", "[]"):
        with pytest.raises(ValueError):
            regex(bad)


def test_pattern_reaches_scan(spark, tmp_path):
    names(spark, FOUR).write.parquet(f"{tmp_path}/c")
    df = spark.read.parquet(f"{tmp_path}/c")
    plan = df.where(matches("a.b.*.z", F.col("name"), F.col("n_segs")))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,a.b.)" in plan and "EqualTo(n_segs,4)" in plan


def test_browse(spark):
    got = [tuple(r) for r in catalog.browse(names(spark, FOUR), "a.*").collect()]
    assert sorted(got) == [("a.b", "b", True), ("a.m", "m", True), ("a.z", "z", False)]


def test_times(spark):
    steps = [1, 7, 60, 420, 604800]
    df = spark.createDataFrame([(t, s) for t in (0, 5, 1704067207, -8) for s in steps], "t long, s long")
    for r in df.select("t", "s", align(F.col("t"), F.col("s")).alias("a")).collect():
        assert r.a == (r.t + EPOCH_SHIFT) // r.s * r.s - EPOCH_SHIFT
    assert duration("210s") == 210 and duration("-2d") == -172800 and duration("1w") == 604800 and duration("5min") == 300
    assert request_time(None, 9) == 9 and request_time("-1h", 7200) == 3600 and request_time("12", 0) == 12
    with pytest.raises(ValueError):
        duration("soon")


LINES = [("metric 0.8 900000000\n", 0.8), ("metric -0.8e-2 900000000\n", -0.008), ("metric 0.8e+2 900000000\n", 80.0), ("metric -8 900000000\n", -8.0), ("metric 8e+2 900000000\n", 800.0), ("metric 0.8 -1\n", 0.8)]


def test_carbon(spark):
    df = spark.createDataFrame([(x,) for x, _ in LINES] + [("a b c",), ("m +1 2",), ("m 01 2",), (None,), ("m..x 1 2",)], "value string")
    got = carbon.parse_lines(df, 900000000).collect()
    assert [(r.name, r.v, r.t) for r in got[: len(LINES)]] == [("metric", v, 900000000) for _, v in LINES]
    assert all(r.malformed and r.name is None for r in got[len(LINES) :])


def test_carbon_round_trip(spark):
    rows = [("a.b", 1.5, 10), ("a.b", -3.0, 11), ("c", 1e20, 12), ("c", 2.5e-7, 13)]
    text = carbon.format_lines(spark.createDataFrame(rows, "name string, v double, t long"))
    assert sorted((r.name, r.v, r.t) for r in carbon.parse_lines(text).collect()) == sorted(rows)


def test_function_table(spark):
    own = {id(f): f for f in FUNCTIONS.values()}
    assert len(own) == 53
    assert function_index(spark).select("name").distinct().count() == 53
    assert call("sum", "a").target == "a"


RULES = [Rule("^drop", 0), Rule("[", 5, 60, "int99"), Rule(".*", 300, 60, "float64")]


def rows_of(store):
    return sorted((r.name, r.t, r.v) for r in store.samples.join(store.catalog.select("id", "name"), "id").select("name", "t", "v").collect())


def test_last_write_wins_and_retention(spark):
    batch = lambda rows: spark.createDataFrame(rows, "name string, v double, t long, seq long")
    s = ingest.merge(empty(spark), batch([("m", 1.0, 605, 1), ("m", 2.0, 659, 2), ("drop.x", 1.0, 600, 3), ("m", None, 700, 4)]), RULES)
    assert rows_of(s) == [("m", 600, 2.0)]
    s = ingest.merge(s, batch([("m", 3.0, 600, 5), ("m", 9.0, 780, 6), ("m", 4.0, 300, 7)]), RULES)  # late, but within retention or not
    assert rows_of(s) == [("m", 600, 3.0), ("m", 780, 9.0)]  # 780 - 300 is later than 300
    s = ingest.merge(s, batch([("m", 7.0, 6000, 8)]), RULES)  # a jump ahead leaves nothing behind
    assert rows_of(s) == [("m", 6000, 7.0)]
    n = ingest.counts(s, batch([("m", 7.0, 6001, 9), ("m", 1.0, 6060, 10), ("m", 1.0, 60, 11)]), RULES).first()
    assert (n.added, n.changed, n.same, n.old) == (1, 0, 1, 1)


def test_one_batch_equals_many(spark):
    rows = [(f"m{i % 3}", float(i), 60 * (i * 7 % 13), i) for i in range(40)]
    batch = lambda r: spark.createDataFrame(r, "name string, v double, t long, seq long")
    rules = [Rule(".*", 10**6, 60, "float64")]
    whole = rows_of(ingest.merge(empty(spark), batch(rows), rules))
    s = empty(spark)
    for part in itertools.batched(rows, 15):
        s = ingest.merge(s, batch(list(part)), rules)
    assert rows_of(s) == whole


def test_a_write_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    batch = lambda *rows: spark.createDataFrame(rows, "name string, v double, t long, seq long")
    rules = [Rule(".*", 10**6, 60, "float64")]
    ingest.write_batch(spark, path, batch(("a", 1.0, 60, 1), ("a", 2.0, 90000, 2)), rules, 0)
    want = rows_of(open_store(spark, path))
    assert want == [("a", 60, 1.0), ("a", 90000, 2.0)]
    real = type(spark.range(1).write).parquet

    def dies(self, at, *more):
        if "/catalog/" in at:
            raise OSError("no more")
        return real(self, at, *more)

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "parquet", dies)
        with pytest.raises(OSError):
            ingest.write_batch(spark, path, batch(("a", 5.0, 60, 3), ("b", 3.0, 180000, 4)), rules, 0)
    assert rows_of(open_store(spark, path)) == want
    for _ in range(2):  # and again, as after a replay
        ingest.write_batch(spark, path, batch(("a", 5.0, 60, 3), ("b", 3.0, 180000, 4)), rules, 0)
        assert rows_of(open_store(spark, path)) == [("a", 60, 5.0), ("a", 90000, 2.0), ("b", 180000, 3.0)]


def test_days_beyond_retention_go_from_disk(spark, tmp_path):
    path = f"{tmp_path}/store"
    batch = lambda *rows: spark.createDataFrame(rows, "name string, v double, t long, seq long")
    rules = [Rule("^long", 10 * 86400, 60, "float64"), Rule(".*", 3600, 60, "float64")]
    day = 86400
    ingest.write_batch(spark, path, batch(("long", 1.0, 60, 1), ("m", 2.0, 60, 2), ("old", 1.0, 60, 3)), rules, 0)
    ingest.write_batch(spark, path, batch(("m", 3.0, 5 * day, 4), ("long", 3.0, 5 * day, 5)), rules, 0)
    days = lambda: sorted(x.name for x in (tmp_path / "store/samples").iterdir() if x.name.startswith("day=") and any(x.iterdir()))
    assert days() == ["day=0", "day=5"]
    compact(spark, path, 5 * day)
    assert rows_of(open_store(spark, path)) == [("long", 60, 1.0), ("long", 5 * day, 3.0), ("m", 5 * day, 3.0)]
    ingest.write_batch(spark, path, batch(("m", 3.0, 40 * day, 6), ("long", 3.0, 40 * day, 7)), rules, 0)
    assert days() == ["day=40"] and rows_of(open_store(spark, path)) == [("long", 40 * day, 3.0), ("m", 40 * day, 3.0)]


def test_names_that_share_a_hash_get_ids_of_their_own(spark, monkeypatch):
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "name" else hashed(*c))
    s = ingest.merge(empty(spark), spark.createDataFrame([("a", 1.0, 60, 1), ("b", 2.0, 60, 2)], "name string, v double, t long, seq long"), [Rule(".*", 600, 60, "float64")])
    s = ingest.merge(s, spark.createDataFrame([("c", 3.0, 60, 3), ("a", 4.0, 60, 4)], "name string, v double, t long, seq long"), [Rule(".*", 600, 60, "float64")])
    assert rows_of(s) == [("a", 60, 4.0), ("b", 60, 2.0), ("c", 60, 3.0)] and s.catalog.select("id").distinct().count() == 3


def test_a_dump_of_a_year_of_minutes(spark):
    n = 525_600
    at = spark.range(n).where("id % 7 <> 3").select(F.lit(1).cast("long").alias("id"), (F.col("id") * 60).alias("t"), F.col("id").cast("double").alias("v"))
    catalog = spark.createDataFrame([(1, "m", 1, "float64", None, 60, 0, None)], CATALOG)
    samples = dump.dump(Store(catalog, at.unionByName(at.where("t = 540"))), "m").first().samples
    assert len(samples) == n and samples[3] is None and samples[9] == 9.0 and samples[-1] == n - 1.0


def test_own_functions(spark):
    library.register("twice", "Transform", lambda q: library.call("scale", q, 2), library.Arg("query", "pathOrFunc"), aliases=("double",))
    try:
        assert library.call("double", "a.b").target == "a.b" and "twice" in {r.name for r in library.function_index(spark).collect()}
        with pytest.raises(ValueError):
            library.register("sum", "Combine", None)
    finally:
        for name in ("twice", "double"):
            del library.FUNCTIONS[name]


def test_stream_into_store(spark, tmp_path):
    path, source = f"{tmp_path}/store", tmp_path / "in"
    source.mkdir()
    write_store(empty(spark), path)
    (source / "1.txt").write_text("a.b 1 60\na.b 2 119\nbad line here\na.c 5 180\n")
    ingest.stream_into(carbon.stream_lines(spark, str(source)), path, f"{tmp_path}/cp", [Rule(".*", 10**6, 60, "float64")]).awaitTermination()
    assert rows_of(open_store(spark, path)) == [("a.b", 60, 2.0), ("a.c", 180, 5.0)]
    (source / "2.txt").write_text("a.b 7 61\na.d 1 100000\n")
    ingest.stream_into(carbon.stream_lines(spark, str(source)), path, f"{tmp_path}/cp", [Rule(".*", 10**6, 60, "float64")]).awaitTermination()
    assert rows_of(open_store(spark, path)) == [("a.b", 60, 7.0), ("a.c", 180, 5.0), ("a.d", 99960, 1.0)]


def test_record_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("a 1 60\nnope\n")
    carbon.record(carbon.stream_lines(spark, str(source)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a 1 60"]


def test_quantize(spark):
    df = spark.createDataFrame([(0.1,), (300.7,), (-300.7,), (float("nan"),), (None,)], "v double")
    got = {k: [r[0] for r in df.select(catalog.quantize(F.col("v"), F.lit(k))).collect()] for k in catalog.TYPES}
    assert got["float32"][0] == 0.10000000149011612 and got["float64"][0] == 0.1
    assert got["int8"] == [0.0, 127.0, -127.0, None, None] and got["int16"] == [0.0, 300.0, -300.0, None, None]


def test_generate_dump_load(spark, tmp_path):
    made = dump.generate(spark, metrics=12, samples=5, start=600)
    assert made.count() == 60 and {r.name for r in made.select("name").distinct().collect()} >= {"test.zero", "test.one.zero", "test.one.one"}
    s = ingest.merge(empty(spark), made.withColumn("seq", F.lit(0)), [Rule(".*", 10**6, 60, "float64")])
    dump.write_dump(dump.dump(s), f"{tmp_path}/d")
    assert rows_of(dump.load(dump.read_dump(spark, f"{tmp_path}/d"))) == rows_of(s)
    assert [tuple(r) for r in dump.analyze(s.samples).collect()] == [(0, 36)]


def test_erase_and_reconfigure(spark):
    s = ingest.merge(empty(spark), dump.generate(spark, metrics=3, samples=2).withColumn("seq", F.lit(0)), [Rule(".*", 10**6, 60, "float64")])
    one = s.catalog.where("name = 'test.one'").select("id")
    assert {r.name for r in erase(s, one).catalog.collect()} == {"test.zero", "test.two"}
    other = reconfigure(s, one.select("id", F.lit("int8").alias("type"), F.lit(60).alias("retention"), F.lit(60).alias("step")))
    assert {n for n, _, _ in rows_of(other)} == {"test.zero", "test.two"} and other.catalog.count() == 3


def test_json_escapes_and_infinity(spark):
    s = Store(spark.createDataFrame([(1, 'a"b', 1, 60)], "id long, name string, n_segs int, step long").selectExpr("*", "cast(null as long) retention", "cast(null as long) last_t"), spark.createDataFrame([(1, 60, 0.0)], "id long, t long, v double"))
    line = as_json(render(s, [call("invert", "**")], 60, 179)).first().json
    assert line == '{"target":"invert(a\\"b)","datapoints":[[1.7976931348623157E308,60],[null,120]]}'


def test_own_measurements(spark, tmp_path):
    from chronoloom.sources.telemetry import FIELDS, ProgressListener

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("a 1 60\n")
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        carbon.record(carbon.stream_lines(spark, str(source)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
        rows = listener.take(spark).collect()
    finally:
        spark.streams.removeListener(listener)
    assert rows and {r.name.rsplit(".", 1)[1] for r in rows} <= set(FIELDS) and all(re.fullmatch(r"[\w.\-]+", r.name) for r in rows)

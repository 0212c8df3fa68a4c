"""Ingest and questions end to end, on small fixtures with known answers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.database import Database, ReadOnly
from tallyframe.operators import distributions as d
from tallyframe.operators import ingest as g
from tallyframe.schema import Categorical, Continuous, Schema, SchemaError
from tallyframe.sources import readers
from tallyframe.store import Conflict, FormatError, Meta
from tallyframe.streaming import ingest_stream
from tests.test_metrics import h, hellinger, jsd, kl, wasserstein

#: Eight readings at two sites; 0.4 and -0.2 stand where a bin's edge and its floating-point value part.
READINGS = """reading,sky,place,day
0.6,rain,north,2023-06-01
-0.2,cloud,north,2023-06-02
0.6,rain,north,2023-07-09
0.95,clear,north,2023-07-20
-0.2,cloud,south,2023-06-11
-0.75,cloud,south,2023-06-30
-0.75,clear,south,2023-07-02
0.4,cloud,south,2023-07-31
"""
SKY = Categorical(("clear", "cloud", "rain"))


@pytest.fixture
def readings(tmp_path):
    (tmp_path / "readings.csv").write_text(READINGS)
    return str(tmp_path / "readings.csv")


def defined(db):
    return db.define_variable("reading", Continuous(10, (-1.0, 1.0))).define_variable("sky", SKY).define_dimension("site", "place").define_joint("reading", "sky")


MAPPING = {"reading": "reading", "sky": "sky", "site": "place"}
#: Counts by hand: of readings in bins of 0.2 from -1 on, and of skies.
NORTH, SOUTH = [0, 0, 0, 0, 1, 0, 0, 0, 2, 1], [0, 2, 0, 0, 1, 0, 1, 0, 0, 0]
NORTH_SKY, SOUTH_SKY = [1, 1, 2], [1, 3, 0]


def known(a, b):
    """The distances of two counts, by plain Python."""
    return jsd(a, b, 4, 4), kl(a, b, 4, 4), kl(b, a, 4, 4), hellinger(a, b, 4, 4)


def test_eight_rows(spark, readings, tmp_path):
    with defined(Database(spark, str(tmp_path / "db"))) as db:
        report = db.ingest_file(readings, MAPPING)
        assert (report.total_rows, report.processed, report.skipped, report.distributions_updated) == (8, 8, 0, 4)
        a, b = {"site": "north"}, {"site": "south"}
        counts = {x["dim_site"]: x["counts"] for x in d.dist(db.cells, db.schema, ["site"], variables=["reading"]).collect()}
        assert counts == {"north": NORTH, "south": SOUTH}
        r = d.compare(db.cells, db.schema, "reading", a, b).first()
        want = known(NORTH, SOUTH)
        assert r["jsd"] == pytest.approx(0.75, abs=1e-12) and r["hellinger"] == pytest.approx(math.sqrt(0.75)) and r["entropy_a"] == pytest.approx(1.5)
        assert (r["jsd"], r["kl_a_to_b"], r["kl_b_to_a"], r["hellinger"]) == pytest.approx(want) and r["psi"] == pytest.approx(want[1] + want[2])
        assert r["wasserstein"] == pytest.approx(wasserstein(NORTH, SOUTH, 4, 4, 0.2)) and (r["ci_upper"], r["sufficient_samples"]) == (pytest.approx(1), False)
        r = d.compare(db.cells, db.schema, "sky", a, b).first()
        assert (r["jsd"], r["kl_a_to_b"], r["kl_b_to_a"], r["hellinger"]) == pytest.approx(known(NORTH_SKY, SOUTH_SKY)) and r["wasserstein"] is None
        table = db.query("COMPARE reading BETWEEN site:north AND site:south")
        assert table.to_dicts()[0] == {"Metric": "JSD", "Value": "0.750000"} and table.rows[-1] == ["Wasserstein", f"{wasserstein(NORTH, SOUTH, 4, 4, 0.2):.6f}"]
    again = Database(spark, str(tmp_path / "db"), mode="ro")
    assert again.query("COMPARE reading BETWEEN site:north AND site:south").to_csv() == table.to_csv()
    with pytest.raises(ReadOnly):
        again.define_variable("x", Continuous(2))


def test_every_statement_answers(spark, readings):
    db = defined(Database(spark))
    db.ingest_file(readings, MAPPING)
    j, ab, ba, hell = known(NORTH_SKY, SOUTH_SKY)
    movers = db.query("COMPARE sky BETWEEN site:north AND site:south").rows
    assert ["--- Top Movers ---", ""] in movers and [x[0] for x in movers[-3:]] == ["cloud", "rain", "clear"]
    assert db.query("COMPARE sky ACROSS site").rows == [["north", "south", f"{j:.6f}", f"{hell:.6f}", f"{ab + ba:.6f}", "4 vs 4"]]
    ex = db.query("EXPLAIN site:north VS site:south").rows
    assert ex[0][:3] == ["TOTAL", f"{j + 0.75:.6f}", "100.0%"] and ex[1][:3] == ["reading", "0.750000", f"{75 / (j + 0.75):.1f}%"]
    show = db.query("SHOW sky AT site:north TOP 1").rows
    assert show[1:3] == [["Samples", "4"], ["Version", "1"]] and show[4][0] == "rain" and show[4][1].endswith(" " + "#" * 20)
    assert db.query("RANK sky BY ENTROPY OVER site").rows[0][:3] == ["north", "1.5000 bits", "4"]
    # at the north a bin has one sky; at the south one bin of three has two
    mi = dict(db.query("MI sky, reading AT site:north").rows)
    assert mi["MI"] == "1.5000 bits" and mi["NMI"] == "1.0000" and mi["Strength"] == "strong"
    south = h(SOUTH, 4) + h(SOUTH_SKY, 4) - h([1, 1, 1, 1], 4)
    assert db.query("CMI sky reading GIVEN site").rows[0][1] == f"{(1.5 + south) / 2:.4f} bits"
    assert len(db.query("CORRELATIONS OVER site LIMIT 1")) == 1 and db.query("CORRELATIONS").rows[0][0] == "reading × sky"
    assert db.query("PAIRWISE site ON sky").rows[0] == ["north", "—", f"{j:.4f}"]
    assert db.query("NEAREST site:south/variable:sky ON site USING hellinger").rows == [["north", f"{hell:.6f}"]]
    assert db.query("STATS").rows == [["Distributions", "4"], ["Total samples", "16"], ["Variables", "2"], ["Dimensions", "1"]]
    assert len(db.query("SCHEMA")) == 4 and db.query("DIMENSIONS").rows == [["site", "2 values"]]
    assert db.query("DIMENSIONS site").rows == [["north"], ["south"]]
    out = db.query("EXPORT DIMENSIONS site AS JSON")
    assert json.loads(out.rows[0][0]) == [{"site": "north"}, {"site": "south"}]
    for bad in ("COMPARE sky BETWEEN site:none AND site:south", "SHOW sky AT site:none", "EXPLAIN site:none VS site:south"):
        with pytest.raises(d.NotFound):
            db.query(bad)
    with pytest.raises(SchemaError):
        db.query("PAIRWISE site ON sky USING nope")


def test_cells_at_the_edges(spark):
    s = Schema().define_variable("x", Continuous(4, (0.0, 4.0))).define_variable("c", Categorical(("a", "b"))).define_variable("k", Categorical(("a", "b"), False)).define_dimension("t")
    rows = [("-5", "a", "a", "1"), ("4", "z", "z", "1"), ("1e3", None, None, "1"), ("nan", "b", "b", "1"), (" 1", "a", "a", "1"), ("1.5d", "a", "a", "1"), (None, "a", "a", "1"), ("2", "a", "a", None)]
    df = spark.createDataFrame(rows, "x string, c string, k string, t string")
    got = {(r["variable"], r["cell"]): r["cnt"] for r in g.cells(df, s).collect()}
    assert got == {("x", 0): 2, ("x", 3): 2, ("c", 0): 4, ("c", 1): 1, ("c", -1): 2, ("k", 0): 4, ("k", 1): 1}
    one = d.dist(g.cells(df, s), s, variables=["c"]).first()
    assert (one["counts"], one["unknown"], one["total"]) == ([4, 1], 2, 7)
    assert one["entropy"] == pytest.approx(-(4 / 7) * math.log2(4 / 7) - (1 / 7) * math.log2(1 / 7))


def test_granularities(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2021-01-04T10:00:00",), ("2021/01/05",)], "t string").withColumn("v", F.lit("a"))
    want = {"daily": {"2021-01-03", "2021-01-04", "2021/01/05"}, "weekly": {"2020-W53", "2021-W01", "2021/01/05"}, "monthly": {"2021-01", "2021/01/05"}, "yearly": {"2021", "2021/01/05"}, None: {"2021-01-03", "2021-01-04T10:00:00", "2021/01/05"}}
    for granularity, values in want.items():
        s = Schema().define_variable("v", Categorical(("a",))).define_dimension("time", "t", granularity)
        assert {r["dim_time"] for r in g.cells(df, s).collect()} == values


def test_track_and_events(spark):
    s = Schema().define_variable("v", Categorical(("a", "b"))).define_dimension("time", granularity="daily")
    rows = [(f"2024-01-{i:02d}", "b" if (i >= 8 or k == 0) else "a") for i in range(1, 15) for k in range(10)]
    cells = g.cells(spark.createDataFrame(rows, "time string, v string"), s)
    series = d.track(cells, s, "v")
    assert series.count() == 14 and series.collect()[-1]["drift"] is None
    assert [(e["time_from"], e["time_to"]) for e in d.drift_events(series).collect()] == []  # all quartiles are 0, so is the threshold
    monthly = d.track(cells, s, "v", granularity="monthly").collect()
    assert [(r["time"], r["samples"]) for r in monthly] == [("2024-01", 140)]
    with pytest.raises(SchemaError):
        d.track(cells, s, "v", granularity="hourly")
    assert d.track(cells, s, "v", start="2024-01-03", end="2024-01-05").count() == 3


def test_inference(spark):
    rows = [{"score": float(i), "color": "abc"[i % 3], "date": f"2024-01-{i + 1:02d}", "year": 2000 + i, "same": 5, "id": f"x{i}", "none": None, "flag": i % 2 == 0, "slash": "2024/01/05"} for i in range(10)]
    s = g.infer_schema(readers.from_records(spark, rows), max_categories=5)
    kinds = {v.name: v.kind for v in s.variables}
    assert kinds["score"].bins == 20 and kinds["score"].range == (0.0, pytest.approx(9.009)) and kinds["same"].range == (5.0, 6.0)
    assert kinds["color"].categories == ("a", "b", "c") and kinds["flag"].categories == ("true", "false")
    assert {x.name: x.granularity for x in s.dimensions} == {"date": "daily", "year": None, "id": None, "slash": "daily"}


def test_inference_counts_values_as_far_as_it_matters(spark, monkeypatch):
    """An empty text is a value; 51 values, or 201 years, are too many; no row is made for each column, and values are not gathered."""
    df = spark.range(6000).select(
        *(F.when(F.col("id") % n != 0, F.concat(F.lit("v"), F.col("id") % n)).otherwise("").alias(f"t{n}") for n in (50, 51, 5000)),
        *(F.when(F.col("id") % 7 != 0, 1900 + F.col("id") % n).alias(f"y{n}") for n in (200, 201)),
    )
    plans, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: (plans.append((out := agg(self, *a))._jdf.queryExecution().optimizedPlan().toString()), out)[1])
    s = g.infer_schema(df, sample_size=None)
    assert {v.name: v.kind.size for v in s.variables} == {"t50": 50, "y201": 20}
    assert {x.name for x in s.dimensions} == {"t51", "t5000", "y200"}
    assert plans and not any("Expand" in x for x in plans)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "t": "a"}\n\n[1, 2]\n{"x": 2, "t": "b"}\n')
    assert sorted(r["x"] for r in readers.read(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception, match="malformed"):
        readers.read(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.csv").write_text("x,t\n1,\n")
    assert readers.read(spark, str(tmp_path / "c.csv")).first().asDict() == {"x": "1", "t": ""}
    (tmp_path / "d.csv").write_text("x,t\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.read(spark, str(tmp_path / "d.csv")).collect()
    with pytest.raises(ValueError, match="unsupported"):
        readers.read(spark, "x.xml")


def test_store_versions_snapshots_and_delta(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), raw_log=True).define_variable("v", Categorical(("a", "b"))).define_dimension("t")
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, v string, t string").write.parquet(str(tmp_path / "in.parquet"))
    source = str(tmp_path / "in.parquet")
    assert db.ingest_delta(source, "id").processed == 2
    spark.createDataFrame([(3, "a", "x"), (4, "a", "y")], "id int, v string, t string").write.mode("append").parquet(source)
    db.snapshot()
    assert db.ingest_delta(source, "id").processed == 2 and db.ingest_delta(source, "id").processed == 0
    again = Database(spark, str(tmp_path / "db"))
    assert again.query("SHOW v AT t:x").rows[1:3] == [["Samples", "3"], ["Version", "2"]]
    assert again.snapshots().agg(F.sum("cnt")).first()[0] == 2 and again.store.read_raw(again.meta).count() == 4
    again.update_cells(spark.createDataFrame([("v", "y", 1, 5)], "variable string, dim_t string, cell int, cnt bigint"))
    assert again.query("SHOW v AT t:y").rows[1] == ["Samples", "6"] and again.snapshots().select("snapshot").distinct().count() == 2


def test_a_failed_ingest_changes_nothing(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "w string, u string")
    for path in (None, str(tmp_path / "db")):
        db = Database(spark, path, raw_log=bool(path)).define_variable("v", Categorical(("a", "b"))).define_dimension("t")
        broken = db.store if path else db
        with monkeypatch.context() as m:
            m.setattr(broken, "write_meta" if path else "_held", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                db.ingest(df, {"v": "w", "t": "u"}, stream=("s", 3))
        assert db.meta.batches == {} and db._tables() is None
        assert db.ingest(df, {"v": "w", "t": "u"}, stream=("s", 3)).processed == 2 and db.ingest(df, {"v": "w", "t": "u"}, stream=("s", 3)).processed == 0
    # the log has the whole rows, dimensions too, once, though the first try had written them
    assert sorted(map(tuple, db.store.read_raw(db.meta).select("w", "u").collect())) == [("a", "x"), ("b", "y")]


@pytest.mark.parametrize("stored", [False, True])
def test_delta_at_the_mark(spark, tmp_path, stored):
    """Rows with the mark's value, equal rows and rows without a value, of a type finer than seconds."""
    source, kind = str(tmp_path / "in.parquet"), "id string, v string, t string"

    def add(*rows):
        spark.createDataFrame(rows, kind).select(F.col("id").cast("timestamp").alias("id"), "v", "t").write.mode("append").parquet(source)

    db = Database(spark, str(tmp_path / "db") if stored else None).define_variable("v", Categorical(("a", "b"))).define_dimension("t")
    add(("2024-01-01 00:00:00.25", "a", "x"), (None, "a", "x"))
    assert db.ingest_delta(source, "id").processed == 2
    add(("2024-01-01 00:00:00.25", "a", "x"), ("2024-01-01 00:00:00.25", "b", "x"), (None, "a", "x"), ("2024-01-01 00:00:00.5", "b", "x"))
    assert db.ingest_delta(source, "id").processed == 4 and db.ingest_delta(source, "id").processed == 0
    add((None, "b", "x"))
    assert db.ingest_delta(source, "id").processed == 1 and db.query("SHOW v AT t:x").rows[1] == ["Samples", "7"]


def test_writers_and_formats(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x")], "v string, t string")
    one = Database(spark, str(tmp_path / "db")).define_variable("v", Categorical(("a", "b"))).define_dimension("t")
    one.ingest(df)
    two = Database(spark, str(tmp_path / "db"))
    two.ingest(df)
    with pytest.raises(Conflict):
        one.ingest(df)
    assert Database(spark, str(tmp_path / "db")).query("SHOW v AT t:x").rows[1] == ["Samples", "2"]
    two.ingest(df)
    # an ingest adds a part; the parts of a version are written as one now and then
    assert len(two.meta.parts) == 3 and two.store.forget(two.meta) == 1 and two.query("SHOW v AT t:x").rows[1:3] == [["Samples", "3"], ["Version", "3"]]
    with monkeypatch.context() as m:
        m.setattr("tallyframe.store.COMPACT", 4)
        two.ingest(df)
        assert len(two.meta.parts) == 1 and two.store.forget(two.meta) == 3
        two.ingest(df)
    assert len(two.meta.parts) == 2 and Database(spark, str(tmp_path / "db"), mode="ro").query("SHOW v AT t:x").rows[1:3] == [["Samples", "5"], ["Version", "5"]]
    (tmp_path / "db/meta.lock").write_text("")
    with pytest.raises(Conflict):
        two.ingest(df)
    with pytest.raises(FormatError):
        Meta.from_json('{"format": 99}')


def test_stream_equals_batch_and_replays_once(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.uniform(0, 10), r.choice(["p", "q"])) for _ in range(300)]
    kind = "v string, x double, t string"
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def new(path):
        return Database(spark, path).define_variable("v", Categorical(("a", "b"))).define_variable("x", Continuous(5, (0.0, 10.0))).define_dimension("t").define_joint("v", "x")

    live, batch = new(str(tmp_path / "live")), new(None)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream, live, str(tmp_path / "checkpoint")).awaitTermination()
    df = spark.createDataFrame(rows, kind)
    batch.ingest(df)
    key = lambda f: sorted(map(str, f.select(*sorted(f.columns)).collect()))
    assert key(live.cells) == key(batch.cells) and key(live.joint_cells) == key(batch.joint_cells)
    assert live.ingest(df, stream=("default", 0)).processed == 0 and key(live.cells) == key(batch.cells)


def test_empty_tables(spark):
    s = Schema().define_variable("v", Categorical(("a",))).define_dimension("t").define_joint("v", "v")
    cells = g.cells(spark.createDataFrame([], "v string, t string"), s)
    assert cells.count() == 0 and d.dist(cells, s).count() == 0 and d.pairwise(cells, s, "v", "t").count() == 0
    assert d.stats(cells, s).first()["total_samples"] == 0
    with pytest.raises(SchemaError):
        g.cells(spark.createDataFrame([], "v string"), s)


def test_inner_group_structure(spark):
    """Pairwise is symmetric with a zero diagonal; explain's fractions add up to 1."""
    r = random.Random(3)
    rows = [(r.gauss(k * 0.1, 1), r.choice("lcr"), f"t{k}") for k in range(5) for _ in range(400)]
    s = Schema().define_variable("x", Continuous(50, (-3.0, 3.0))).define_variable("v", Categorical(("l", "c", "r"))).define_dimension("topic")
    cells = g.cells(spark.createDataFrame(rows, "x double, v string, topic string"), s)
    got = {(p["value_a"], p["value_b"]): p["distance"] for p in d.pairwise(cells, s, "x", "topic").collect()}
    assert len(got) == 25 and all(got[a, b] == got[b, a] and (a != b or x == 0) for (a, b), x in got.items())
    assert sum(x["fraction"] for x in d.explain(cells, s, {"topic": "t0"}, {"topic": "t4"}).collect()) == pytest.approx(1)
    assert d.pairwise_matrix(cells, s, "x", "topic").columns == ["value", "t0", "t1", "t2", "t3", "t4"]


def test_shell_and_remembered_answers(spark, readings, tmp_path, capsys, monkeypatch):
    from tallyframe import cli

    path = str(tmp_path / "db")
    db = defined(Database(spark, path))
    db.ingest_file(readings, MAPPING)
    assert cli.main([]) == 2 and "STATEMENT" in capsys.readouterr().out
    assert cli.main([path, "DIMENSIONS", "site"]) == 0 and "north" in capsys.readouterr().out
    said = iter(["STATS", "", "NONSENSE", "SHOW sky AT site:none", "quit"])
    monkeypatch.setattr("builtins.input", lambda _: next(said))
    assert cli.main([path]) == 0
    out = capsys.readouterr().out
    assert "Total samples" in out and out.count("error:") == 2
    # an answer is given again without a job, as one's own copy, until rows come in
    first = db.query("SHOW sky AT site:north")
    with monkeypatch.context() as m:
        m.setattr(db, "execute", None)
        first.rows[1][1] = "changed"
        again = db.query("SHOW sky AT site:north")
        assert again.rows[1] == ["Samples", "4"]
    db.ingest_file(readings, MAPPING)
    assert db.query("SHOW sky AT site:north").rows[1:3] == [["Samples", "8"], ["Version", "2"]]


def test_server_and_tools(spark, readings, tmp_path):
    from tallyframe.server import answer
    from tallyframe.tools import Tools

    db = Database(spark).define_variable("v", Categorical(("a", "b"))).define_dimension("t")
    assert answer(db, "POST", "/ingest", b'[{"v": "a", "t": "x"}, 3, {"v": "b", "t": "y"}]') == (200, {"processed": 2, "skipped": 0})
    assert answer(db, "POST", "/ingest", b"3")[0] == 400 and answer(db, "POST", "/ingest", b"{")[0] == 400 and answer(db, "GET", "/nothing")[0] == 404
    assert answer(db, "GET", "/query?q=DIMENSIONS+t")[1]["rows"] == [["x"], ["y"]] and answer(db, "GET", "/query?q=WHAT")[0] == 400
    assert answer(db, "GET", "/overview")[1]["stats"]["distributions"] == 2
    tools = Tools(spark)
    with pytest.raises(ValueError, match="open"):
        tools.call("query", q="STATS")
    tools.call("create_database", path=str(tmp_path / "db"))
    assert json.loads(tools.call("ingest_file", path=readings))["processed"] == 8
    assert "PAIRWISE" in tools.call("help") and len(tools.names()) == 8
    assert {r["Name"] for r in json.loads(tools.call("schema"))} == {"reading", "sky", "place", "day"}
    assert json.loads(tools.call("list_dimensions"))[0]["Dimension"] == "day"
    tools.call("open_database", path=str(tmp_path / "db"))
    with pytest.raises(ReadOnly):
        tools.call("ingest_file", path=readings)

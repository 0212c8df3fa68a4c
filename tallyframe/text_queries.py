"""Queries that go through the whole database: files of text as input, and statements as text, with SQL for each.

The rows of a statement's table come as ``line`` (their order) and text columns c1, c2, ...
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .database import Database
from .plans.render import QueryResult
from .queries import EVENT, FACED, FLAG, ORDERS, STATUS, VALUE, YEAR, _distance_sql, _labels, plog, sql_cells, sql_dense, table
from .schema import Categorical

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder that executors can write to: the session's shared one; only on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can write to")
    return f"{shared or tempfile.mkdtemp(prefix='tallyframe-')}/text-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- files of text

#: Of an event's number: its value as text (blanks, suffixes, words, nothing), its time (no date, another form, a bare day), its type.
_VALUE_TEXT = "CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN concat(' ', CAST(event_id % 400 AS {s})) WHEN event_id % 13 = 0 THEN '1e2' WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN '-inf' WHEN event_id % 23 = 0 THEN '3d' ELSE CAST(event_id % 500 AS {s}) END"
_TIME_TEXT = "CASE WHEN event_id % 29 = 0 THEN '2024/01/05' WHEN event_id % 31 = 0 THEN '2024-01-07' WHEN event_id % 37 = 0 THEN 'soon' ELSE {t} END"
_TYPE_TEXT = "CASE WHEN event_id % 41 = 0 THEN 'other, \"quoted\"' ELSE event_type END"
_DAY = f"CASE WHEN event_id % 29 = 0 THEN '2024/01/05' WHEN event_id % 31 = 0 THEN '2024-01-07' WHEN event_id % 37 = 0 THEN 'soon' ELSE {YEAR['events']} END"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return table(spark, sf_dir, "events").select(F.expr(_VALUE_TEXT.format(s="string")).alias("value"), F.expr(_TIME_TEXT.format(t=time)).alias("ts"), F.expr(_TYPE_TEXT).alias("event_type"), "event_id")


def _events_schema(db: Database) -> Database:
    return db.define_variable("event_type", EVENT).define_variable("value", VALUE).define_dimension("time", "ts", "daily")


_NUMBER = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 5 WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 19 = 0 THEN 0 WHEN event_id % 23 = 0 THEN NULL ELSE CAST((event_id % 500) // 20 AS INTEGER) END"
_TYPE_CELL = "CASE WHEN event_id % 41 = 0 THEN -1 ELSE " + q.sql_cell("event_type", EVENT) + " END"


def _text_sql(value: str, kind: str, where: str = "true") -> str:
    each = f"SELECT 'value' AS variable, {_DAY} AS dim_time, {value} AS cell FROM events WHERE {where} UNION ALL SELECT 'event_type', {_DAY}, {kind} FROM events WHERE {where}"
    return f"SELECT variable, dim_time, CAST(cell AS INTEGER) AS cell, CAST(count(*) AS BIGINT) AS cnt FROM ({each}) u WHERE cell IS NOT NULL GROUP BY ALL"


@register(_text_sql(_NUMBER, _TYPE_CELL))
def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a header, whose fields are all text: what is no number is no value, what is no date stays as it is."""
    path = f"{_folder(spark)}.csv"
    _texts(spark, sf_dir).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    db = _events_schema(Database(spark))
    db.ingest_file(path)
    return db.cells


@register(_text_sql(_NUMBER, f"CASE WHEN event_id % 43 = 0 THEN -1 ELSE {_TYPE_CELL} END", "event_id % 47 <> 0"))
def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object a line, some without a type, some without a time."""
    path = f"{_folder(spark)}.json"
    rows = _texts(spark, sf_dir)
    rows = rows.withColumn("event_type", F.when(F.col("event_id") % 43 != 0, F.col("event_type"))).withColumn("ts", F.when(F.col("event_id") % 47 != 0, F.col("ts")))
    rows.write.json(path)
    db = _events_schema(Database(spark))
    db.ingest_file(path)
    return db.cells


@register(
    f"SELECT 'read' AS what, CAST(count(*) AS BIGINT) AS n FROM events UNION ALL SELECT 'processed', CAST(count(*) AS BIGINT) FROM events WHERE event_id % 47 <> 0 UNION ALL SELECT 'skipped', CAST(count(*) AS BIGINT) FROM events WHERE event_id % 47 = 0 "
    f"UNION ALL SELECT 'updated', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT dim_time, variable FROM ({_text_sql(_NUMBER, f'CASE WHEN event_id % 43 = 0 THEN -1 ELSE {_TYPE_CELL} END', 'event_id % 47 <> 0')}) u) v"
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, processed and skipped, and distributions touched, with a mapping to other names."""
    rows = _texts(spark, sf_dir).withColumn("event_type", F.when(F.col("event_id") % 43 != 0, F.col("event_type"))).withColumn("ts", F.when(F.col("event_id") % 47 != 0, F.col("ts")))
    r = _events_schema(Database(spark)).ingest(rows.toDF("number", "day", "kind", "id"), {"value": "number", "event_type": "kind", "time": "day"})
    return spark.createDataFrame([("read", r.total_rows), ("processed", r.processed), ("skipped", r.skipped), ("updated", r.distributions_updated)], "what string, n bigint")


@register(
    "SELECT 'variable' AS type, 'nation' AS name, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS size FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL"
    " SELECT 'variable', 'price', CAST(20 AS BIGINT) UNION ALL SELECT 'dimension', 'year', CAST(0 AS BIGINT) UNION ALL SELECT 'dimension', 'day', CAST(0 AS BIGINT) UNION ALL SELECT 'dimension', 'customer', CAST(0 AS BIGINT)"
)
def infer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of columns of a CSV file, from all its rows: categories, numbers, years, days, and too many values; an empty column is left out."""
    from .operators import ingest

    path = f"{_folder(spark)}.csv"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    cols = [F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("nation"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")]
    o.select(*cols, F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("customer"), F.lit(None).cast("string").alias("nothing")).write.option("header", True).csv(path)
    from .sources import readers

    s = ingest.infer_schema(readers.read(spark, path).replace("", None), sample_size=None)
    return spark.createDataFrame([("variable", v.name, v.kind.size) for v in s.variables] + [("dimension", x.name, 0) for x in s.dimensions], "type string, name string, size bigint")


def _orders_delta(spark: SparkSession, sf_dir: str) -> tuple[Database, str, list[DataFrame]]:
    """A database in a folder, a growing source, and what comes: each part ends in the middle of a date, and one has rows without a date."""
    folder = _folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.to_date("o_orderdate").alias("at"))
    o = o.withColumn("at", F.when(F.col("o_orderkey") % 50 != 0, F.col("at")))
    early, late = F.col("at") < F.lit("1995-03-01").cast("date"), F.col("at") > F.lit("1995-03-01").cast("date")
    at = F.col("at") == F.lit("1995-03-01").cast("date")
    odd = F.col("o_orderkey") % 2 == 1
    parts = [o.where(early | (at & odd) | (F.col("at").isNull() & odd)), o.where((at & ~odd) | (F.col("at").isNull() & ~odd)), o.where(late)]
    db = Database(spark, f"{folder}/db", raw_log=True).define_variable("o_orderstatus", q.ORDER_STATUS).define_dimension("time", "o_orderdate", "yearly")
    return db, f"{folder}/orders.parquet", parts


@register(f"SELECT 'o_orderstatus' AS variable, time AS dim_time, cell, cnt FROM ({sql_cells('orders', 'o_orderstatus', q.ORDER_STATUS, {'time': YEAR['orders']})}) s")
def delta_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that grows three times, also at the mark and by rows without an order; read after each, and once more."""
    db, source, parts = _orders_delta(spark, sf_dir)
    for part in parts:
        part.write.mode("append").parquet(source)
        db.ingest_delta(source, "at")
    assert db.ingest_delta(source, "at").processed == 0
    return db.cells


@register("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log holds every row that was ingested, whole, once."""
    db, source, parts = _orders_delta(spark, sf_dir)
    for part in parts:
        part.write.mode("append").parquet(source)
        db.ingest_delta(source, "at")
    return db.store.read_raw(db.meta).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_BEFORE = f"({sql_cells('orders', 'o_orderstatus', q.ORDER_STATUS, {'time': YEAR['orders']}, 'o_totalprice < 250000')})"


@register(f"WITH b AS {_BEFORE}, a AS ({sql_cells('orders', 'o_orderstatus', q.ORDER_STATUS, {'time': YEAR['orders']})}) SELECT 'o_orderstatus' AS variable, a.time AS dim_time, a.cell, CAST(coalesce(b.cnt, 0) AS BIGINT) AS cnt_before, a.cnt AS cnt_after FROM a LEFT JOIN b ON a.time = b.time AND a.cell = b.cell WHERE coalesce(b.cnt, 0) <> a.cnt")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot between two ingests against the cells as they are, in a database that was opened again."""
    from .operators import distributions as d

    path = f"{_folder(spark)}/db"
    db = Database(spark, path).define_variable("o_orderstatus", q.ORDER_STATUS).define_dimension("time", "o_orderdate", "yearly")
    o = table(spark, sf_dir, "orders")
    db.ingest(o.where("o_totalprice < 250000"))
    db.snapshot()
    db.ingest(o.where("o_totalprice >= 250000"))
    again = Database(spark, path, mode="ro")
    return d.changes(again.snapshots().drop("snapshot", "taken_at"), again.cells, again.schema)


@register(f"SELECT 'o_orderstatus' AS variable, {YEAR['orders']} AS dim_time, CAST(2 AS BIGINT) AS version FROM orders GROUP BY 2 HAVING count(*) FILTER (o_totalprice < 250000) > 0 AND count(*) FILTER (o_totalprice >= 250000) > 0 UNION ALL SELECT 'o_orderstatus', {YEAR['orders']}, CAST(1 AS BIGINT) FROM orders GROUP BY 2 HAVING count(*) FILTER (o_totalprice < 250000) = 0 OR count(*) FILTER (o_totalprice >= 250000) = 0")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark).define_variable("o_orderstatus", q.ORDER_STATUS).define_dimension("time", "o_orderdate", "yearly")
    o = table(spark, sf_dir, "orders")
    db.ingest(o.where("o_totalprice < 250000"))
    db.ingest(o.where("o_totalprice >= 250000"))
    return db._some()[2].drop("last_updated")


# ---------------------------------------------------------------- statements


def _rows(spark: SparkSession, r: QueryResult) -> DataFrame:
    width = len(r.header)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(r.rows)], ", ".join(["line int", *(f"c{i + 1} string" for i in range(width))]))


def _line_db(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.meta.schema = q.lineitem_schema()
    db.ingest(table(spark, sf_dir, "lineitem"))
    return db


def _orders_db(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.meta.schema = q.orders_schema()
    db.ingest(q.orders(spark, sf_dir))
    return db


def _events_db(spark: SparkSession, sf_dir: str) -> Database:
    db = _events_schema(Database(spark))
    db.ingest(table(spark, sf_dir, "events"))
    return db


_DATABASES = {"lineitem": _line_db, "orders": _orders_db, "events": _events_db}


def _lines(source: str, *rows: str) -> str:
    """SQL of a table of fixed lines over the one row of ``source``; each row is its columns' expressions."""
    return f"WITH src AS ({source}) " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS line, {', '.join(f'{e} AS c{j + 1}' for j, e in enumerate(row))} FROM src" for i, row in enumerate(rows))


def _ordered(source: str, order: str, *columns: str, start: int = 0) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 + {start} AS INTEGER) AS line, {', '.join(f'{e} AS c{j + 1}' for j, e in enumerate(columns))} FROM ({source}) o"


def f(places: int, x: str, tail: str = "") -> str:
    return f"printf('%.{places}f{tail}', {x})"


def statement(name: str, source: str, text: str, sql: str) -> None:
    QUERIES[f"say_{name}"] = lambda spark, sf_dir: _rows(spark, _DATABASES[source](spark, sf_dir).query(text))
    ORACLE[f"say_{name}"] = sql


_COMPARED = [
    ("'JSD'", f(6, "jsd")), ("'PSI'", f(6, "psi")), ("'Hellinger'", f(6, "hellinger")), ("'KL(A→B)'", f(6, "kl_a_to_b")), ("'KL(B→A)'", f(6, "kl_b_to_a")), ("'Entropy(A)'", f(4, "entropy_a", " bits")), ("'Entropy(B)'", f(4, "entropy_b", " bits")),
    ("'Samples'", "concat(samples_a, ' vs ', samples_b)"), ("'95% CI'", "printf('[%.4f, %.4f]', ci_lower, ci_upper)"),
]
statement("compare", "lineitem", "COMPARE l_extendedprice BETWEEN time:1996 AND time:1999;", _lines(q.ORACLE["compare_hist"], *_COMPARED, ("'Wasserstein'", f(6, "wasserstein"))))
statement("compare_where", "orders", "compare o_totalprice between time:1996 and time:1998 where segment:BUILDING", _lines(q.ORACLE["compare_where"], *_COMPARED, ("'Wasserstein'", f(6, "wasserstein"))))


def _movers_sql(kinds: dict[str, Categorical], source: str, key: str, a: str, b: str, limit: int) -> str:
    each = []
    for n, k in kinds.items():
        part = f"({plog('p', '(p + q) / 2')} + {plog('q', '(p + q) / 2')}) / 2"
        each.append(f"SELECT * FROM (WITH {sql_dense(sql_cells(source, n, k, {'k': key}), k)}, {FACED} SELECT '{n}' AS variable, l.category, p, q, q - p AS delta, {part} AS contribution, row_number() OVER (ORDER BY abs(q - p) DESC, l.category) AS rank FROM x JOIN (VALUES {_labels(k)}) l(cell, category) ON l.cell = x.cell WHERE ka = '{a}' AND kb = '{b}' QUALIFY rank <= {limit}) m_{n}")
    return " UNION ALL ".join(each)


statement(
    "movers", "events", "COMPARE event_type BETWEEN time:2024-01-02 AND time:2024-01-20",
    _lines(q._compare_sql(sql_cells("events", "event_type", EVENT, {"k": YEAR["events"]}), EVENT, "2024-01-02", "2024-01-20"), *_COMPARED, ("''", "''"), ("'--- Top Movers ---'", "''"))
    + " UNION ALL SELECT CAST(10 + rank AS INTEGER), category, printf('%+.4f  (%.3f → %.3f)  contrib=%.4f', delta, p, q, contribution) FROM (" + _movers_sql({"event_type": EVENT}, "events", YEAR["events"], "2024-01-02", "2024-01-20", 10) + ") v",
)
statement("across", "lineitem", "COMPARE l_returnflag ACROSS time", _ordered(q.ORACLE["compare_across"], "round(jsd, 6) DESC, value_a, value_b", "value_a", "value_b", f(6, "jsd"), f(6, "hellinger"), f(6, "psi"), "concat(samples_a, ' vs ', samples_b)"))
statement(
    "explain", "lineitem", "EXPLAIN time:1995 VS time:2001",
    f"WITH e AS ({q.ORACLE['explain']}), m AS ({_movers_sql({'l_returnflag': FLAG, 'l_linestatus': STATUS}, 'lineitem', YEAR['lineitem'], '1995', '2001', 5)}), "
    "u AS (SELECT 1e9::DOUBLE AS o, '' AS v, 0 AS r, 'TOTAL' AS c1, printf('%.6f', any_value(total)) AS c2, '100.0%' AS c3, '' AS c4, '' AS c5 FROM e "
    "UNION ALL SELECT jsd, variable, 0, variable, printf('%.6f', jsd), concat(printf('%.1f', fraction * 100), '%'), printf('%.4f', entropy_a), printf('%.4f', entropy_b) FROM e "
    "UNION ALL SELECT e.jsd, e.variable, m.rank, concat('  ', m.category), printf('%+.4f', m.delta), printf('contrib=%.4f', m.contribution), '', '' FROM m JOIN e ON e.variable = m.variable) "
    "SELECT CAST(row_number() OVER (ORDER BY o DESC, v, r) - 1 AS INTEGER) AS line, c1, c2, c3, c4, c5 FROM u",
)
statement(
    "track", "events", "TRACK value FROM time:2024-01-01",
    f"WITH s AS ({q.ORACLE['track']}), e AS ({q.ORACLE['track_events']}), "
    "u AS (SELECT 0 AS part, time AS o, time AS c1, printf('%.4f', entropy) AS c2, concat(printf('%.4f', coalesce(drift, 0)), CASE WHEN drift > 0.05 THEN ' ← shift' ELSE '' END) AS c3 FROM s "
    "UNION ALL SELECT 1, '', '', '', '' WHERE (SELECT count(*) FROM e) > 0 UNION ALL SELECT 2, time_from, concat(time_from, ' → ', time_to), printf('JSD=%.4f', jsd), printf('drift above %.4f', threshold) FROM e) "
    "SELECT CAST(row_number() OVER (ORDER BY part, o) - 1 AS INTEGER) AS line, c1, c2, c3 FROM u",
)
_SHOWN = f"WITH {sql_dense(sql_cells('events', 'value', VALUE, {'k': YEAR['events']}), VALUE)}, g5 AS (SELECT g.cell, l.label, n, total FROM g JOIN (VALUES {_labels(VALUE)}) l(cell, label) ON l.cell = g.cell WHERE k = '2024-01-05')"
for _order, _by in (("TOP", "n DESC, cell"), ("BOTTOM", "n, cell")):
    statement(
        f"show_{_order.lower()}", "events", f"SHOW value AT time:2024-01-05 {_order} 5",
        f"{_SHOWN}, h AS (SELECT sum(CASE WHEN n > 0 THEN -(n / total) * log2(n / total) ELSE CAST(0 AS DOUBLE) END) AS entropy, any_value(total) AS total FROM g5) SELECT CAST(0 AS INTEGER) AS line, 'Entropy' AS c1, {f(4, 'entropy', ' bits')} AS c2 FROM h "
        f"UNION ALL SELECT 1, 'Samples', CAST(CAST(total AS BIGINT) AS VARCHAR) FROM h UNION ALL SELECT 2, 'Version', '1' UNION ALL SELECT 3, '', '' "
        f"UNION ALL SELECT CAST(3 + i AS INTEGER), label, printf('%6d  %.4f  %s', CAST(n AS BIGINT), n / total, repeat('#', CAST(floor(n / total * 40) AS INTEGER))) FROM (SELECT *, row_number() OVER (ORDER BY {_by}) AS i FROM g5) t WHERE i <= 5",
    )
statement("rank", "lineitem", "RANK l_extendedprice BY ENTROPY OVER time", _ordered(q.ORACLE["rank_entropy"], "entropy DESC, value", "value", f(4, "entropy", " bits"), "CAST(samples AS VARCHAR)", "repeat('#', CAST(floor(entropy * 8) AS INTEGER))"))
statement("mi", "lineitem", "MI l_returnflag, l_quantity AT time:1998", _lines(q.ORACLE["mi"], ("'MI'", f(4, "mi", " bits")), ("'NMI'", f(4, "nmi")), ("'Cramér''s V'", f(4, "cramers_v")), ("'Samples'", "CAST(samples AS VARCHAR)"), ("'Strength'", "strength")))
statement(
    "cmi", "lineitem", "CMI l_returnflag l_linestatus GIVEN time",
    _lines(q.ORACLE["cmi"], ("'CMI'", f(4, "cmi", " bits"), "''", "''"), ("'Total samples'", "CAST(samples AS VARCHAR)", "''", "''"), ("''", "''", "''", "''"))
    + " UNION ALL " + _ordered(q.ORACLE["cmi_per_value"], "value", "value", f(4, "mi"), f"concat({f(1, 'nmi * 100')}, '%')", "CAST(samples AS VARCHAR)", start=3),
)
statement("correlations", "orders", "CORRELATIONS LIMIT 5 OVER segment LIMIT 20", _ordered(q.ORACLE["correlations_over"], "mi DESC, var_a, var_b, key", "concat(var_a, ' × ', var_b)", "key", f(4, "mi"), f"concat({f(1, 'nmi * 100')}, '%')", f(4, "cramers_v"), "CAST(samples AS VARCHAR)"))
statement("nearest", "events", "NEAREST time:2024-01-15 ON time LIMIT 5 USING psi", _ordered(q.ORACLE["nearest_psi"], "distance, value", "value", f(6, "distance")))
statement("nearest_wasserstein", "events", "NEAREST time:2024-01-15/variable:value ON time LIMIT 4 USING wasserstein",
    f"WITH {sql_dense(sql_cells('events', 'value', VALUE, {'k': YEAR['events']}), VALUE)}, {FACED}, y AS (SELECT *, sum(p - q) OVER (PARTITION BY ka, kb ORDER BY cell) AS gap FROM x), w AS (SELECT kb AS value, {_distance_sql('wasserstein', VALUE)} AS distance FROM y WHERE ka = '2024-01-15' AND kb <> ka GROUP BY kb ORDER BY 2, 1 LIMIT 4) SELECT CAST(row_number() OVER (ORDER BY distance, value) - 1 AS INTEGER) AS line, value AS c1, printf('%.6f', distance) AS c2 FROM w")
statement("pairwise", "lineitem", "EXPORT PAIRWISE time ON l_quantity USING hellinger AS CSV",
    f"WITH p AS ({q.ORACLE['pairwise_hellinger']}), r AS (SELECT value_a, concat(value_a, ',', string_agg(CASE WHEN value_a = value_b THEN '—' ELSE printf('%.4f', distance) END, ',' ORDER BY value_b)) AS row FROM p GROUP BY value_a) SELECT CAST(0 AS INTEGER) AS line, concat(',', string_agg(value_a, ',' ORDER BY value_a), chr(10), string_agg(row, chr(10) ORDER BY value_a), chr(10)) AS c1 FROM r")
statement("stats", "events", "STATS and what follows", _lines(q.ORACLE["stats"], ("'Distributions'", "CAST(distributions AS VARCHAR)"), ("'Total samples'", "CAST(total_samples AS VARCHAR)"), ("'Variables'", "CAST(variables AS VARCHAR)"), ("'Dimensions'", "CAST(dimensions AS VARCHAR)")))
statement("schema", "events", "SCHEMA", "SELECT CAST(line AS INTEGER) AS line, c1, c2, c3 FROM (VALUES (0, 'variable', 'event_type', 'categorical  cats=5  unknown=true'), (1, 'variable', 'value', 'continuous  bins=25  range=[0, 500]'), (2, 'dimension', 'time', 'source=ts  granularity=daily')) t(line, c1, c2, c3)")
statement("dimensions", "orders", "DIMENSIONS", f"SELECT CAST(0 AS INTEGER) AS line, 'time' AS c1, concat(count(DISTINCT {YEAR['orders']}), ' values') AS c2 FROM {ORDERS} UNION ALL SELECT 1, 'segment', concat(count(DISTINCT c_mktsegment), ' values') FROM {ORDERS}")
statement("export_json", "events", "EXPORT DIMENSIONS time AS JSON", "SELECT CAST(0 AS INTEGER) AS line, concat('[', string_agg(concat('{\"time\":\"', k, '\"}'), ',' ORDER BY k), ']') AS c1 FROM (SELECT DISTINCT " + YEAR["events"] + " AS k FROM events) e")

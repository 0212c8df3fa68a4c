"""Queries of the distribution engine over the synthetic star schema, with independent SQL for each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics
from .operators import distributions as d
from .operators import ingest
from .schema import Categorical, Continuous, Schema

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- what is measured

QUANTITY = Continuous(20, (1.0, 51.0))
PRICE = Continuous(20, (900.0, 105000.0))
DISCOUNT = Continuous(11, (0.0, 0.11))
TAX = Continuous(9, (0.0, 0.09))
TOTAL = Continuous(20, (1000.0, 500000.0))
BALANCE = Continuous(20, (-1000.0, 10000.0))
VALUE = Continuous(25, (0.0, 500.0))
FLAG, STATUS = Categorical(("A", "N", "R"), False), Categorical(("F", "O"), False)
ORDER_STATUS = Categorical(("F", "O", "P"), False)
PRIORITY = Categorical(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), True)
EVENT = Categorical(("click", "error", "purchase", "signup", "view"), True)


def lineitem_schema() -> Schema:
    s = Schema()
    for n, k in (("l_returnflag", FLAG), ("l_linestatus", STATUS), ("l_quantity", QUANTITY), ("l_extendedprice", PRICE), ("l_discount", DISCOUNT), ("l_tax", TAX)):
        s.define_variable(n, k)
    s.define_dimension("time", "l_shipdate", "yearly")
    return s.define_joint("l_returnflag", "l_linestatus").define_joint("l_returnflag", "l_quantity").define_joint("l_quantity", "l_discount")


def orders_schema(granularity: str = "yearly") -> Schema:
    s = Schema()
    for n, k in (("o_orderstatus", ORDER_STATUS), ("o_orderpriority", PRIORITY), ("o_totalprice", TOTAL), ("c_acctbal", BALANCE)):
        s.define_variable(n, k)
    return s.define_dimension("time", "o_orderdate", granularity).define_dimension("segment", "c_mktsegment").define_joint("o_orderstatus", "o_orderpriority").define_joint("o_orderstatus", "o_totalprice")


def events_schema(granularity: str = "daily") -> Schema:
    return Schema().define_variable("event_type", EVENT).define_variable("value", VALUE).define_dimension("time", "ts", granularity)


def one(name: str, kind, source: str, granularity: str | None) -> Schema:
    return Schema().define_variable(name, kind).define_dimension("time", source, granularity)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))


def lineitem_cells(spark: SparkSession, sf_dir: str, *variables: str) -> tuple[DataFrame, Schema]:
    """Cells of the variables (none named: of all), from the rows."""
    s = lineitem_schema()
    return ingest.cells(table(spark, sf_dir, "lineitem"), s, variables=list(variables) or None), s


def orders_cells(spark: SparkSession, sf_dir: str, *variables: str) -> tuple[DataFrame, Schema]:
    s = orders_schema()
    return ingest.cells(orders(spark, sf_dir), s, variables=list(variables) or None), s


def events_cells(spark: SparkSession, sf_dir: str, *variables: str) -> tuple[DataFrame, Schema]:
    s = events_schema()
    return ingest.cells(table(spark, sf_dir, "events"), s, variables=list(variables) or None), s


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- SQL of the oracle

ORDERS = "orders JOIN customer ON o_custkey = c_custkey"
YEAR = {"lineitem": "strftime(l_shipdate, '%Y')", "orders": "strftime(o_orderdate, '%Y')", "events": "strftime(ts, '%Y-%m-%d')"}


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def sql_cell(column: str, kind) -> str:
    if isinstance(kind, Continuous):
        return f"CAST(greatest(0, least({kind.bins - 1}, CAST(floor(({column} - {dbl(kind.low)}) / {dbl(kind.width)}) AS BIGINT))) AS INTEGER)"
    whens = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(kind.categories))
    return f"CAST(CASE {column} {whens} {'ELSE -1' if kind.allow_unknown else ''} END AS INTEGER)"


def sql_cells(source: str, column: str, kind, keys: dict[str, str], where: str = "true") -> str:
    names = "".join(f"{e} AS {n}, " for n, e in keys.items())
    return f"SELECT {names}{sql_cell(column, kind)} AS cell, CAST(count(*) AS BIGINT) AS cnt FROM {source} WHERE {where} AND {sql_cell(column, kind)} IS NOT NULL GROUP BY ALL"


def sql_dense(cells: str, kind) -> str:
    """CTEs c (k, cell, cnt), t (k, total), g (k, cell, n, total): all declared cells of each k."""
    return f"c AS ({cells}), t AS (SELECT k, CAST(sum(cnt) AS DOUBLE) AS total FROM c GROUP BY k), g AS (SELECT t.k, r.cell, CAST(coalesce(c.cnt, 0) AS DOUBLE) AS n, t.total FROM t CROSS JOIN (SELECT CAST(range AS INTEGER) AS cell FROM range({kind.size})) r LEFT JOIN c ON c.k = t.k AND c.cell = r.cell)"


def plog(p: str, m: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ({m})) ELSE CAST(0 AS DOUBLE) END"


JSD = f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), sum(({plog('p', '(p + q) / 2')} + {plog('q', '(p + q) / 2')}) / 2)))"


def sql_kl(p: str, b: str, tb: str, k: int) -> str:
    return f"sum({plog(p, f'({b} + 1e-10::DOUBLE) / ({tb} + {k} * 1e-10::DOUBLE)')})"


HELLINGER = "sqrt(sum(power(sqrt(p) - sqrt(q), 2)) / 2)"
ENTROPY = "sum(CASE WHEN n > 0 THEN -(n / total) * log2(n / total) ELSE CAST(0 AS DOUBLE) END)"
#: Two keys' dense cells side by side.
FACED = "x AS (SELECT a.k AS ka, b.k AS kb, a.cell, a.n AS na, b.n AS nb, a.total AS ta, b.total AS tb, a.n / a.total AS p, b.n / b.total AS q FROM g a JOIN g b ON a.cell = b.cell)"


def r9(e: str) -> str:
    return f"round({e}, 9) + CAST(0 AS DOUBLE)"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ingest

LINE_SHORT = {"time": YEAR["lineitem"]}


def _union(source: str, kinds: dict[str, object], keys: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS variable, * FROM ({sql_cells(source, n, k, keys)}) s" for n, k in kinds.items())


@register(f"SELECT variable, time AS dim_time, cell, cnt FROM ({_union('lineitem', {'l_quantity': QUANTITY, 'l_extendedprice': PRICE, 'l_discount': DISCOUNT, 'l_tax': TAX}, LINE_SHORT)}) u")
def cells_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = lineitem_cells(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return c.where(F.col("variable").isin("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@register(f"SELECT variable, time AS dim_time, cell, cnt FROM ({_union('lineitem', {'l_returnflag': FLAG, 'l_linestatus': STATUS}, LINE_SHORT)}) u")
def cells_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = lineitem_cells(spark, sf_dir, "l_returnflag", "l_linestatus")
    return c.where(F.col("variable").isin("l_returnflag", "l_linestatus"))


TWO_FLAGS = Categorical(("A", "N"), True)


@register(f"SELECT variable, time AS dim_time, cell, cnt FROM ({_union('lineitem', {'l_returnflag': TWO_FLAGS}, LINE_SHORT)}) u")
def cells_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cells(table(spark, sf_dir, "lineitem"), one("l_returnflag", TWO_FLAGS, "l_shipdate", "yearly"))


NARROW = Continuous(10, (10.0, 40.0))


@register(f"SELECT variable, time AS dim_time, cell, cnt FROM ({_union('lineitem', {'l_quantity': NARROW}, LINE_SHORT)}) u")
def cells_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cells(table(spark, sf_dir, "lineitem"), one("l_quantity", NARROW, "l_shipdate", "yearly"))


for _name, _format in (("daily", "%Y-%m-%d"), ("weekly", "%G-W%V"), ("monthly", "%Y-%m"), ("yearly", "%Y")):

    def _dims(spark: SparkSession, sf_dir: str, granularity: str = _name) -> DataFrame:
        return ingest.cells(table(spark, sf_dir, "orders"), one("o_orderstatus", ORDER_STATUS, "o_orderdate", granularity))

    QUERIES[f"dim_{_name}"] = _dims
    ORACLE[f"dim_{_name}"] = f"SELECT 'o_orderstatus' AS variable, time AS dim_time, cell, cnt FROM ({sql_cells('orders', 'o_orderstatus', ORDER_STATUS, {'time': f"strftime(o_orderdate, '{_format}')"})}) s"


def _joint_sql(x: str, kx, y: str, ky) -> str:
    a, b = min(x, y), max(x, y)
    return f"SELECT '{a}' AS var_a, '{b}' AS var_b, {YEAR['lineitem']} AS dim_time, {sql_cell(x, kx)} AS x, {sql_cell(y, ky)} AS y, CAST(count(*) AS BIGINT) AS cnt FROM lineitem GROUP BY ALL"


def _joint(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    return ingest.joint_cells(table(spark, sf_dir, "lineitem"), lineitem_schema()).where((F.col("var_a") == a) & (F.col("var_b") == b))


@register(_joint_sql("l_linestatus", STATUS, "l_returnflag", FLAG))
def joint_cat_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir, "l_linestatus", "l_returnflag")


@register(_joint_sql("l_returnflag", FLAG, "l_quantity", QUANTITY))
def joint_cat_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir, "l_quantity", "l_returnflag")


@register(_joint_sql("l_discount", DISCOUNT, "l_quantity", QUANTITY))
def joint_cont_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir, "l_discount", "l_quantity")


@register(f"SELECT time, cell, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({sql_cells(ORDERS, 'o_totalprice', TOTAL, {'time': YEAR['orders']})}) s GROUP BY ALL")
def merge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_totalprice")
    one_ = d.dist(c, s, ["time"], variables=["o_totalprice"])
    return one_.select(F.col("dim_time").alias("time"), F.posexplode("counts").alias("cell", "cnt")).where("cnt > 0")


@register(f"WITH {sql_dense(sql_cells(ORDERS, 'o_orderpriority', PRIORITY, {'k': 'c_mktsegment'}), PRIORITY)} SELECT k AS segment, {r9(ENTROPY)} AS entropy, CAST(any_value(total) AS BIGINT) AS samples FROM g GROUP BY k")
def entropy_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_orderpriority")
    return rounded(d.dist(c, s, ["segment"], variables=["o_orderpriority"]).select(F.col("dim_segment").alias("segment"), "entropy", F.col("total").alias("samples")))


# ---------------------------------------------------------------- compare


def _compare_sql(cells: str, kind, a: str, b: str) -> str:
    n = kind.size
    width = f"{r9(f'(SELECT sum(abs(gap)) FROM (SELECT sum(p - q) OVER (ORDER BY cell) AS gap FROM x WHERE ka = {a!r} AND kb = {b!r}) w) * {dbl(kind.width)}')}" if isinstance(kind, Continuous) else "CAST(NULL AS DOUBLE)"
    return (
        f"WITH {sql_dense(cells, kind)}, {FACED}, m AS (SELECT {JSD} AS jsd, {sql_kl('p', 'nb', 'tb', n)} AS ab, {sql_kl('q', 'na', 'ta', n)} AS ba, {HELLINGER} AS hellinger, sum({plog('p', 'CAST(1 AS DOUBLE)')}) AS ea, sum({plog('q', 'CAST(1 AS DOUBLE)')}) AS eb, any_value(ta) AS ta, any_value(tb) AS tb FROM x WHERE ka = '{a}' AND kb = '{b}'), "
        "e AS (SELECT *, sqrt(greatest(jsd, 1e-12::DOUBLE) * greatest(1 - jsd, 1e-12::DOUBLE) / (ta * tb / (ta + tb))) AS se FROM m) "
        f"SELECT {r9('jsd')} AS jsd, round(ab + ba, 9) AS psi, {r9('hellinger')} AS hellinger, {r9('ab')} AS kl_a_to_b, {r9('ba')} AS kl_b_to_a, {r9('-ea')} AS entropy_a, {r9('-eb')} AS entropy_b, CAST(ta AS BIGINT) AS samples_a, CAST(tb AS BIGINT) AS samples_b, {width} AS wasserstein, {r9('greatest(CAST(0 AS DOUBLE), jsd - 1.96::DOUBLE * se)')} AS ci_lower, {r9('least(CAST(1 AS DOUBLE), jsd + 1.96::DOUBLE * se)')} AS ci_upper, (ta >= 30 AND tb >= 30) AS sufficient_samples FROM e"
    )


@register(_compare_sql(sql_cells("lineitem", "l_returnflag", FLAG, {"k": YEAR["lineitem"]}), FLAG, "1995", "2000"))
def compare_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir, "l_returnflag")
    return rounded(d.compare(c, s, "l_returnflag", {"time": "1995"}, {"time": "2000"}).drop("variable"))


@register(_compare_sql(sql_cells("lineitem", "l_extendedprice", PRICE, {"k": YEAR["lineitem"]}), PRICE, "1996", "1999"))
def compare_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir, "l_extendedprice")
    return rounded(d.compare(c, s, "l_extendedprice", {"time": "1996"}, {"time": "1999"}).drop("variable"))


@register(_compare_sql(sql_cells(ORDERS, "o_totalprice", TOTAL, {"k": YEAR["orders"]}, "c_mktsegment = 'BUILDING'"), TOTAL, "1996", "1998"))
def compare_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_totalprice")
    return rounded(d.compare(c, s, "o_totalprice", {"time": "1996"}, {"time": "1998"}, {"segment": "BUILDING"}).drop("variable"))


def _labels(kind) -> str:
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(kind.labels()))


_MOVERS = f"WITH {sql_dense(sql_cells('events', 'event_type', EVENT, {'k': YEAR['events']}), EVENT)}, {FACED}"


@register(f"{_MOVERS} SELECT l.category, {r9('p')} AS prob_a, {r9('q')} AS prob_b, {r9('q - p')} AS delta, {r9(f'({plog('p', '(p + q) / 2')} + {plog('q', '(p + q) / 2')}) / 2')} AS contribution, CAST(row_number() OVER (ORDER BY abs(q - p) DESC, l.category) AS INTEGER) AS rank FROM x JOIN (VALUES {_labels(EVENT)}) l(cell, category) ON l.cell = x.cell WHERE ka = '2024-01-02' AND kb = '2024-01-20' QUALIFY rank <= 3")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "event_type")
    return rounded(d.movers(c, s, ["event_type"], {"time": "2024-01-02"}, {"time": "2024-01-20"}, 3).drop("variable"))


def _across_sql(cells: str, kind) -> str:
    n = kind.size
    return f"WITH {sql_dense(cells, kind)}, {FACED} SELECT ka AS value_a, kb AS value_b, {r9(JSD)} AS jsd, {r9(HELLINGER)} AS hellinger, round({sql_kl('p', 'nb', 'tb', n)} + {sql_kl('q', 'na', 'ta', n)}, 9) AS psi, CAST(any_value(ta) AS BIGINT) AS samples_a, CAST(any_value(tb) AS BIGINT) AS samples_b FROM x WHERE ka < kb GROUP BY ka, kb"


@register(_across_sql(sql_cells("lineitem", "l_returnflag", FLAG, {"k": YEAR["lineitem"]}), FLAG))
def compare_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir, "l_returnflag")
    return rounded(d.across(c, s, "l_returnflag", "time"))


@register(_across_sql(sql_cells(ORDERS, "c_acctbal", BALANCE, {"k": "c_mktsegment"}, f"{YEAR['orders']} = '1997'"), BALANCE))
def compare_across_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "c_acctbal")
    return rounded(d.across(c, s, "c_acctbal", "segment", {"time": "1997"}))


_LINE_KINDS = {"l_returnflag": FLAG, "l_linestatus": STATUS, "l_quantity": QUANTITY, "l_extendedprice": PRICE, "l_discount": DISCOUNT, "l_tax": TAX}


def _explain_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT * FROM (WITH {sql_dense(sql_cells('lineitem', n, k, {'k': YEAR['lineitem']}), k)}, {FACED} SELECT '{n}' AS variable, {JSD} AS jsd, -sum({plog('p', 'CAST(1 AS DOUBLE)')}) AS entropy_a, -sum({plog('q', 'CAST(1 AS DOUBLE)')}) AS entropy_b FROM x WHERE ka = '1995' AND kb = '2001') v_{n}"
        for n, k in _LINE_KINDS.items()
    )
    return f"WITH u AS ({each}) SELECT variable, {r9('jsd')} AS jsd, {r9('entropy_a')} AS entropy_a, {r9('entropy_b')} AS entropy_b, {r9('sum(jsd) OVER ()')} AS total, {r9('jsd / sum(jsd) OVER ()')} AS fraction FROM u"


@register(_explain_sql())
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir)
    return rounded(d.explain(c, s, {"time": "1995"}, {"time": "2001"}))


def _explain_movers_sql() -> str:
    each = []
    for n, k in (("o_orderstatus", ORDER_STATUS), ("o_orderpriority", PRIORITY)):
        each.append(f"SELECT * FROM (WITH {sql_dense(sql_cells(ORDERS, n, k, {'k': 'c_mktsegment'}), k)}, {FACED} SELECT '{n}' AS variable, l.category, {r9('p')} AS prob_a, {r9('q')} AS prob_b, {r9('q - p')} AS delta, {r9(f'({plog('p', '(p + q) / 2')} + {plog('q', '(p + q) / 2')}) / 2')} AS contribution, CAST(row_number() OVER (ORDER BY abs(q - p) DESC, l.category) AS INTEGER) AS rank FROM x JOIN (VALUES {_labels(k)}) l(cell, category) ON l.cell = x.cell WHERE ka = 'AUTOMOBILE' AND kb = 'MACHINERY' QUALIFY rank <= 5) v_{n}")
    return " UNION ALL ".join(each)


@register(_explain_movers_sql())
def explain_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    return rounded(d.movers(c, s, ["o_orderstatus", "o_orderpriority"], {"segment": "AUTOMOBILE"}, {"segment": "MACHINERY"}, 5))


_TRACK = f"WITH {sql_dense(sql_cells('events', 'value', VALUE, {'k': YEAR['events']}), VALUE)}, {FACED}, h AS (SELECT k, {ENTROPY} AS entropy, any_value(total) AS total FROM g GROUP BY k), s AS (SELECT k, lead(k) OVER (ORDER BY k) AS next_k FROM h), f AS (SELECT ka, kb, {JSD} AS drift FROM x GROUP BY ka, kb), series AS (SELECT h.k AS time, h.entropy, CAST(h.total AS BIGINT) AS samples, s.next_k AS next_time, f.drift FROM h JOIN s ON s.k = h.k LEFT JOIN f ON f.ka = h.k AND f.kb = s.next_k)"


@register(f"{_TRACK} SELECT time, {r9('entropy')} AS entropy, samples, next_time, {r9('drift')} AS drift FROM series")
def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.track(c, s, "value"))


@register(f"{_TRACK} SELECT time, {r9('entropy')} AS entropy, samples, next_time, {r9('drift')} AS drift FROM series WHERE time >= '2024-01-10' AND time < '2024-01-20' UNION ALL SELECT time, {r9('entropy')}, samples, NULL, NULL FROM series WHERE time = '2024-01-20'")
def track_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.track(c, s, "value", start="2024-01-10", end="2024-01-20"))


@register(f"{_TRACK}, o AS (SELECT drift, row_number() OVER (ORDER BY drift) AS i, count(*) OVER () AS n FROM series WHERE drift IS NOT NULL), q AS (SELECT max(CASE WHEN i = n // 4 + 1 THEN drift END) AS q1, max(CASE WHEN i = n // 2 + 1 THEN drift END) AS q2, max(CASE WHEN i = 3 * n // 4 + 1 THEN drift END) AS q3 FROM o), th AS (SELECT CASE WHEN q3 - q1 < 1e-12 THEN 3 * q2 ELSE q3 + 1.5::DOUBLE * (q3 - q1) END AS threshold FROM q) SELECT time AS time_from, next_time AS time_to, {r9('drift')} AS jsd, {r9('threshold')} AS threshold FROM series, th WHERE drift > threshold AND threshold > 0")
def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.drift_events(d.track(c, s, "value")))


# ---------------------------------------------------------------- show, rank, associations


def _show_sql(source: str, column: str, kind, key: str, value: str, tail: str = "") -> str:
    return f"WITH {sql_dense(sql_cells(source, column, kind, {'k': key}), kind)} SELECT g.cell, l.label, CAST(n AS BIGINT) AS cnt, {r9('n / total')} AS prob FROM g JOIN (VALUES {_labels(kind)}) l(cell, label) ON l.cell = g.cell WHERE k = '{value}' {tail}"


@register(_show_sql(ORDERS, "o_orderpriority", PRIORITY, "c_mktsegment", "HOUSEHOLD"))
def show_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_orderpriority")
    return rounded(d.show(c, s, "o_orderpriority", {"segment": "HOUSEHOLD"}))


@register(_show_sql("events", "value", VALUE, YEAR["events"], "2024-01-05"))
def show_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.show(c, s, "value", {"time": "2024-01-05"}))


@register(_show_sql("events", "value", VALUE, YEAR["events"], "2024-01-05", "ORDER BY n DESC, g.cell LIMIT 5"))
def show_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.show(c, s, "value", {"time": "2024-01-05"}, top=5))


@register(_show_sql("events", "value", VALUE, YEAR["events"], "2024-01-05", "ORDER BY n, g.cell LIMIT 5"))
def show_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir, "value")
    return rounded(d.show(c, s, "value", {"time": "2024-01-05"}, bottom=5))


@register(f"WITH {sql_dense(sql_cells('lineitem', 'l_extendedprice', PRICE, {'k': YEAR['lineitem']}), PRICE)} SELECT k AS value, {r9(ENTROPY)} AS entropy, CAST(any_value(total) AS BIGINT) AS samples FROM g GROUP BY k")
def rank_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir, "l_extendedprice")
    return rounded(d.rank_entropy(c, s, "l_extendedprice", "time"))


def _assoc_sql(source: str, x: str, kx, y: str, ky, key: str) -> str:
    small = min(kx.size - 1, ky.size - 1)
    return (
        f"j AS (SELECT {key} AS k, {sql_cell(x, kx)} AS x, {sql_cell(y, ky)} AS y, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE {sql_cell(x, kx)} >= 0 AND {sql_cell(y, ky)} >= 0 GROUP BY ALL), jt AS (SELECT k, sum(n) AS t FROM j GROUP BY k), jx AS (SELECT k, x, sum(n) AS r FROM j GROUP BY k, x), jy AS (SELECT k, y, sum(n) AS c FROM j GROUP BY k, y), "
        "hx AS (SELECT jx.k, -sum(r / t * log2(r / t)) AS h FROM jx JOIN jt ON jx.k = jt.k GROUP BY jx.k), hy AS (SELECT jy.k, -sum(c / t * log2(c / t)) AS h FROM jy JOIN jt ON jy.k = jt.k GROUP BY jy.k), "
        "a AS (SELECT j.k, sum(n / t * log2(n * t / (r * c))) AS mi, any_value(t) AS t FROM j JOIN jt ON j.k = jt.k JOIN jx ON jx.k = j.k AND jx.x = j.x JOIN jy ON jy.k = j.k AND jy.y = j.y GROUP BY j.k), "
        "chi AS (SELECT jx.k, sum(power(coalesce(n, 0) - r * c / t, 2) / (r * c / t)) AS chi FROM jx JOIN jy ON jx.k = jy.k JOIN jt ON jt.k = jx.k LEFT JOIN j ON j.k = jx.k AND j.x = jx.x AND j.y = jy.y GROUP BY jx.k), "
        f"assoc AS (SELECT a.k, a.mi, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), a.mi / least(hx.h, hy.h))) AS nmi, least(CAST(1 AS DOUBLE), sqrt(chi / (a.t * {small}))) AS v, CAST(a.t AS BIGINT) AS samples FROM a JOIN hx ON hx.k = a.k JOIN hy ON hy.k = a.k JOIN chi ON chi.k = a.k)"
    )


@register(f"WITH {_assoc_sql('lineitem', 'l_returnflag', FLAG, 'l_quantity', QUANTITY, YEAR['lineitem'])} SELECT {r9('mi')} AS mi, {r9('nmi')} AS nmi, {r9('v')} AS cramers_v, samples, CASE WHEN mi > 0.3 THEN 'strong' WHEN mi > 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM assoc WHERE k = '1998'")
def mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitem_schema()
    j = ingest.joint_cells(table(spark, sf_dir, "lineitem"), s)
    return rounded(d.mutual_information(j, s, "l_returnflag", "l_quantity", {"time": "1998"}).drop("var_a", "var_b"))


_CMI = f"WITH {_assoc_sql('lineitem', 'l_linestatus', STATUS, 'l_returnflag', FLAG, YEAR['lineitem'])}"


@register(f"{_CMI} SELECT {r9('sum(mi * samples) / sum(samples)')} AS cmi, CAST(sum(samples) AS BIGINT) AS samples FROM assoc")
def cmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitem_schema()
    j = ingest.joint_cells(table(spark, sf_dir, "lineitem"), s)
    return rounded(d.conditional_mutual_information(j, s, "l_returnflag", "l_linestatus", "time"))


@register(f"{_CMI} SELECT k AS value, {r9('mi')} AS mi, {r9('nmi')} AS nmi, {r9('v')} AS cramers_v, samples FROM assoc")
def cmi_per_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitem_schema()
    j = ingest.joint_cells(table(spark, sf_dir, "lineitem"), s)
    return rounded(d.cmi_per_value(j, s, "l_returnflag", "l_linestatus", "time"))


def _correlations_sql(key: str, limit: int) -> str:
    each = " UNION ALL ".join(f"SELECT * FROM (WITH {_assoc_sql(ORDERS, 'o_orderstatus', ORDER_STATUS, y, k, key)} SELECT 'o_orderstatus' AS o, '{y}' AS y, * FROM assoc) v_{y}" for y, k in (("o_orderpriority", PRIORITY), ("o_totalprice", TOTAL)))
    return f"SELECT least(o, y) AS var_a, greatest(o, y) AS var_b, k AS key, {r9('mi')} AS mi, {r9('nmi')} AS nmi, {r9('v')} AS cramers_v, samples FROM ({each}) u ORDER BY mi DESC, 1, 2, k LIMIT {limit}"


@register(_correlations_sql(f"concat('segment:', c_mktsegment, '/time:', {YEAR['orders']})", 10))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders_schema()
    return rounded(d.correlations(ingest.joint_cells(orders(spark, sf_dir), s), s, limit=10))


@register(_correlations_sql("c_mktsegment", 20))
def correlations_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders_schema()
    return rounded(d.correlations(ingest.joint_cells(orders(spark, sf_dir), s), s, "segment"))


def _distance_sql(metric: str, kind) -> str:
    n = kind.size
    return {"jsd": JSD, "hellinger": HELLINGER, "psi": f"{sql_kl('p', 'nb', 'tb', n)} + {sql_kl('q', 'na', 'ta', n)}", "wasserstein": f"sum(abs(gap)) * {dbl(kind.width) if isinstance(kind, Continuous) else 0}"}[metric]


for _metric in ("jsd", "hellinger", "psi", "wasserstein"):

    def _pairwise(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        c, s = lineitem_cells(spark, sf_dir, "l_quantity")
        return rounded(d.pairwise(c, s, "l_quantity", "time", metric), 8)

    QUERIES[f"pairwise_{_metric}"] = _pairwise
    ORACLE[f"pairwise_{_metric}"] = f"WITH {sql_dense(sql_cells('lineitem', 'l_quantity', QUANTITY, {'k': YEAR['lineitem']}), QUANTITY)}, {FACED}, y AS (SELECT *, sum(p - q) OVER (PARTITION BY ka, kb ORDER BY cell) AS gap FROM x) SELECT ka AS value_a, kb AS value_b, CASE WHEN ka = kb THEN CAST(0 AS DOUBLE) ELSE round({_distance_sql(_metric, QUANTITY)}, 8) + CAST(0 AS DOUBLE) END AS distance FROM y GROUP BY ka, kb"

for _metric in ("jsd", "hellinger", "psi"):

    def _nearest(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        c, s = events_cells(spark, sf_dir, "event_type")
        return rounded(d.nearest(c, s, "event_type", {"time": "2024-01-15"}, "time", 5, metric))

    QUERIES[f"nearest_{_metric}"] = _nearest
    ORACLE[f"nearest_{_metric}"] = f"WITH {sql_dense(sql_cells('events', 'event_type', EVENT, {'k': YEAR['events']}), EVENT)}, {FACED} SELECT kb AS value, {r9(_distance_sql(_metric, EVENT))} AS distance FROM x WHERE ka = '2024-01-15' AND kb <> ka GROUP BY kb ORDER BY {_distance_sql(_metric, EVENT)}, kb LIMIT 5"


@register(f"WITH {sql_dense(sql_cells(ORDERS, 'o_orderpriority', PRIORITY, {'k': 'c_mktsegment'}), PRIORITY)}, {FACED}, m AS (SELECT kb, {JSD} AS jsd, any_value(ta) AS ta, any_value(tb) AS tb FROM x WHERE ka = 'AUTOMOBILE' AND kb <> ka GROUP BY kb), e AS (SELECT *, sqrt(greatest(jsd, 1e-12::DOUBLE) * greatest(1 - jsd, 1e-12::DOUBLE) / (ta * tb / (ta + tb))) AS se FROM m) SELECT kb AS value, {r9('jsd')} AS jsd, {r9('greatest(CAST(0 AS DOUBLE), jsd - 1.96::DOUBLE * se)')} AS ci_lower, {r9('least(CAST(1 AS DOUBLE), jsd + 1.96::DOUBLE * se)')} AS ci_upper FROM e")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir, "o_orderpriority")
    both = d.across(c, s, "o_orderpriority", "segment").where("value_a = 'AUTOMOBILE'")
    low, high, _ = metrics.confidence(F.col("jsd"), F.col("samples_a"), F.col("samples_b"))
    return rounded(both.select(F.col("value_b").alias("value"), "jsd", low.alias("ci_lower"), high.alias("ci_upper")))


@register(f"WITH {sql_dense(sql_cells('lineitem', 'l_quantity', QUANTITY, {'k': YEAR['lineitem']}), QUANTITY)} SELECT k AS time, CAST(j AS INTEGER) AS cell, CAST(sum(round(n * greatest(CAST(0 AS DOUBLE), least({dbl(1.0)} + (j + 1) * {dbl(50 / 7)}, {dbl(1.0)} + g.cell * {dbl(2.5)} + {dbl(2.5)}) - greatest({dbl(1.0)} + j * {dbl(50 / 7)}, {dbl(1.0)} + g.cell * {dbl(2.5)})) / {dbl(2.5)})) AS BIGINT) AS cnt FROM g CROSS JOIN (SELECT range AS j FROM range(7)) r GROUP BY k, j")
def rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = lineitem_cells(spark, sf_dir, "l_quantity")
    held = d.dist(c, s, ["time"], variables=["l_quantity"])
    return held.select(F.col("dim_time").alias("time"), F.posexplode(metrics.rebin(F.col("counts"), 1.0, 51.0, 1.0, 51.0, 7)).alias("cell", "cnt"))


@register("SELECT coalesce(a.label, b.label) AS label, CAST(coalesce(a.n, 0) AS BIGINT) AS count_a, CAST(coalesce(b.n, 0) AS BIGINT) AS count_b FROM (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1) a FULL OUTER JOIN (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1) b ON a.label = b.label")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    small, large = (part.where(w).groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("cnt")) for w in ("p_size <= 10", "p_size > 45"))
    return d.align(small, large)


# ---------------------------------------------------------------- the database itself


@register(f"SELECT CAST(count(*) AS BIGINT) AS distributions, CAST(sum(n) AS BIGINT) AS total_samples, CAST(2 AS BIGINT) AS variables, CAST(1 AS BIGINT) AS dimensions FROM (SELECT {YEAR['events']} AS k, 'a' AS v, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT {YEAR['events']}, 'b', count(*) FROM events GROUP BY 1) u")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = events_cells(spark, sf_dir)
    return d.stats(c, s)


@register("SELECT * FROM (VALUES ('variable', 'event_type', 'categorical  cats=5  unknown=true'), ('variable', 'value', 'continuous  bins=25  range=[0, 500]'), ('dimension', 'time', 'source=ts  granularity=daily')) t(type, name, details)")
def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(d.describe(events_schema()), "type string, name string, details string")


@register(f"SELECT 'segment' AS dimension, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS cardinality FROM {ORDERS} UNION ALL SELECT 'time', CAST(count(DISTINCT {YEAR['orders']}) AS BIGINT) FROM {ORDERS}")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"dim_{n}").alias("value")) for n in s.dims))).alias("e")
    return c.select(each).select("e.*").groupBy("dimension").agg(F.count_distinct("value").alias("cardinality"))


@register(f"SELECT DISTINCT {YEAR['orders']} AS value FROM {ORDERS}")
def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = orders_cells(spark, sf_dir)
    return d.dimension_values(c, s, "time")


_PART_SQL = "SELECT '{0}' AS name, 'continuous' AS kind, CAST(20 AS BIGINT) AS size, CAST(min({0}) AS DOUBLE) AS low, round(max({0}) + CASE WHEN max({0}) = min({0}) THEN 1.0 ELSE (CAST(max({0}) AS DOUBLE) - min({0})) * 0.001::DOUBLE END, 9) AS high FROM part"
_PART_TEXT = "SELECT '{0}', CASE WHEN count(DISTINCT {0}) > 50 THEN 'dimension' ELSE 'categorical' END, CAST(CASE WHEN count(DISTINCT {0}) > 50 THEN 0 ELSE count(DISTINCT {0}) END AS BIGINT), NULL, NULL FROM part"


@register(" UNION ALL ".join([*(_PART_SQL.format(c) for c in ("p_partkey", "p_size", "p_retailprice")), *(_PART_TEXT.format(c) for c in ("p_name", "p_brand", "p_type"))]))
def infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.infer_schema(table(spark, sf_dir, "part"), sample_size=None)
    rows = [(v.name, type(v.kind).__name__.lower(), v.kind.size, *((v.kind.low, round(v.kind.high, 9)) if isinstance(v.kind, Continuous) else (None, None))) for v in s.variables]
    return spark.createDataFrame(rows + [(x.name, "dimension", 0, None, None) for x in s.dimensions], "name string, kind string, size bigint, low double, high double")


def _database(spark: SparkSession, sf_dir: str):
    from .database import Database

    db = Database(spark).define_variable("event_type", EVENT).define_variable("value", VALUE).define_dimension("time", "ts", "daily")
    db.ingest(table(spark, sf_dir, "events"))
    return db


@register("SELECT concat('time', chr(10), string_agg(k, chr(10) ORDER BY k), chr(10)) AS Output FROM (SELECT DISTINCT " + YEAR["events"] + " AS k FROM events) e")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _database(spark, sf_dir).query("EXPORT DIMENSIONS time AS CSV")
    return spark.createDataFrame(r.rows, "Output string")


@register("SELECT concat('[', string_agg(concat('{\"time\":\"', k, '\"}'), ',' ORDER BY k), ']') AS Output FROM (SELECT DISTINCT " + YEAR["events"] + " AS k FROM events) e")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _database(spark, sf_dir).query("EXPORT DIMENSIONS time AS JSON")
    return spark.createDataFrame(r.rows, "Output string")


@register(f"SELECT variable, time AS dim_time, cell, cnt FROM ({_union('events', {'event_type': EVENT, 'value': VALUE}, {'time': YEAR['events']})}) u")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, counted as they come."""
    from .database import Database
    from .streaming import ingest_stream

    db = Database(spark).define_variable("event_type", EVENT).define_variable("value", VALUE).define_dimension("time", "ts", "daily")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can write to")
    folder = folder or tempfile.mkdtemp(prefix="tallyframe-stream-")
    ingest_stream(stream, db, f"{folder}/stream-{uuid.uuid4().hex}").awaitTermination()
    return db.cells


@register(f"SELECT variable, source AS dim_source, cell, cnt FROM ({_union('documents', {'lang': Categorical(('de', 'en', 'es', 'fr')), 'n_chars': Continuous(20, (0.0, 20000.0))}, {'source': 'source'})}) u")
def cells_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Schema().define_variable("lang", Categorical(("de", "en", "es", "fr"))).define_variable("n_chars", Continuous(20, (0.0, 20000.0))).define_dimension("source")
    return ingest.cells(table(spark, sf_dir, "documents"), s)

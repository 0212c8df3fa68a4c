"""Distributions and everything asked of them. Typed DataFrames in, typed DataFrames out.

Every function takes the ``cells`` (or ``joint_cells``) and their schema. Conditions are {dimension: value};
dimensions that a question does not name are merged, that is, summed over. Cells are few (variables x keys x
declared cells), whatever the number of rows they count, so only their aggregation is ever large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode
from ..functions import metrics as m
from ..schema import Categorical, Continuous, Schema, SchemaError
from .ingest import dim

Where = dict[str, str]


class NotFound(LookupError):
    """No distribution answers to the reference."""


def _check(schema: Schema, names) -> None:
    for n in names:
        schema.dimension(n)


def _filter(df: DataFrame, schema: Schema, where: Where | None) -> DataFrame:
    _check(schema, where or {})
    for k, v in (where or {}).items():
        df = df.where(F.col(f"`{dim(k)}`") == F.lit(v))
    return df


def domain(cells: DataFrame, schema: Schema) -> DataFrame:
    """variable, cell, label, lo, hi of all declared cells."""
    rows = []
    for v in schema.variables:
        for i, label in enumerate(v.kind.labels()):
            c = isinstance(v.kind, Continuous)
            rows.append((v.name, i, label, v.kind.low + i * v.kind.width if c else None, v.kind.low + (i + 1) * v.kind.width if c else None))
    return cells.sparkSession.createDataFrame(rows, "variable string, cell int, label string, lo double, hi double")


def dist(cells: DataFrame, schema: Schema, by: list[str] = (), where: Where | None = None, variables: list[str] | None = None) -> DataFrame:
    """One row for each variable and values of ``by``: counts (dense), unknown, total, entropy. The rest is merged."""
    _check(schema, by)
    names = variables or [v.name for v in schema.variables]
    keys = [f"`{dim(d)}`" for d in by]
    kept = _filter(cells, schema, where).where(F.col("variable").isin(names))
    merged = kept.groupBy("variable", *keys, "cell").agg(F.sum("cnt").alias("cnt"))
    held = merged.groupBy("variable", *keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "cnt"))).alias("m"), F.sum("cnt").alias("total"))
    out = held.select("variable", *keys, _dense("m", _size(schema, names)).alias("counts"), F.coalesce(F.try_element_at("m", F.lit(encode.UNKNOWN)), F.lit(0).cast("bigint")).alias("unknown"), "total")
    return out.withColumn("entropy", m.entropy(F.col("counts"), F.col("total")))


def _width(schema: Schema, variable: str) -> float | None:
    kind = schema.variable(variable).kind
    return kind.width if isinstance(kind, Continuous) else None


def _dense(counts: str, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0).cast("bigint")))


def _size(schema: Schema, names: list[str]) -> Column:
    size: Column = F.lit(0)
    for n in names:
        size = F.when(F.col("variable") == n, schema.variable(n).kind.size).otherwise(size)
    return size


def _matches(schema: Schema, where: Where) -> Column:
    _check(schema, where)
    out = F.lit(True)
    for k, v in where.items():
        out = out & (F.col(f"`{dim(k)}`") == F.lit(v))
    return out


def _two(cells: DataFrame, schema: Schema, variables: list[str], a: Where, b: Where) -> DataFrame:
    """counts_a, counts_b, ... of each variable that has both, from one pass over the cells."""
    in_a, in_b = _matches(schema, a), _matches(schema, b)
    sums = cells.where(F.col("variable").isin(variables) & (in_a | in_b)).groupBy("variable", "cell").agg(F.sum(F.when(in_a, F.col("cnt"))).alias("a"), F.sum(F.when(in_b, F.col("cnt"))).alias("b"))
    held = sums.groupBy("variable").agg(*(x for s in "ab" for x in (F.map_from_entries(F.collect_list(F.struct("cell", s))).alias(f"m_{s}"), F.sum(s).alias(f"total_{s}")))).where("total_a is not null and total_b is not null")
    dense = held.select("variable", *(x for s in "ab" for x in (_dense(f"m_{s}", _size(schema, variables)).alias(f"counts_{s}"), f"total_{s}")))
    return dense.withColumns({f"entropy_{s}": m.entropy(F.col(f"counts_{s}"), F.col(f"total_{s}")) for s in "ab"})


def _abt() -> tuple[Column, Column, Column, Column]:
    return F.col("counts_a"), F.col("counts_b"), F.col("total_a"), F.col("total_b")


def _must(df: DataFrame, what: str) -> DataFrame:
    """df, if it has a row."""
    if df.isEmpty():
        raise NotFound(what)
    return df


def compare(cells: DataFrame, schema: Schema, variable: str, a: Where, b: Where, where: Where | None = None) -> DataFrame:
    """One row with all distances of two distributions; ``where`` adds to, and overrides, both references."""
    both = _two(cells, schema, [variable], a | (where or {}), b | (where or {}))
    x = _abt()
    width = _width(schema, variable)
    out = both.select("variable", m.jsd(*x).alias("jsd"), m.psi(*x).alias("psi"), m.hellinger(*x).alias("hellinger"), m.kl(*x).alias("kl_a_to_b"), m.kl(x[1], x[0], x[3], x[2]).alias("kl_b_to_a"), "entropy_a", "entropy_b", F.col("total_a").alias("samples_a"), F.col("total_b").alias("samples_b"), (m.wasserstein(*x, F.lit(width)) if width is not None else F.lit(None).cast("double")).alias("wasserstein"))
    low, high, enough = m.confidence(F.col("jsd"), F.col("samples_a"), F.col("samples_b"))
    return out.withColumns({"ci_lower": low, "ci_upper": high, "sufficient_samples": enough})


def movers(cells: DataFrame, schema: Schema, variables: list[str], a: Where, b: Where, limit: int) -> DataFrame:
    """The categories whose share changed most: variable, rank, category, prob_a, prob_b, delta, contribution."""
    chosen = [v for v in variables if isinstance(schema.variable(v).kind, Categorical)]
    both = _two(cells, schema, chosen or ["\0"], a, b) if chosen else _two(cells, schema, variables, a, b).where(F.lit(False))
    ca, cb, ta, tb = _abt()
    parts = F.arrays_zip(m.probabilities(ca, ta).alias("p"), m.probabilities(cb, tb).alias("q"), m.jsd_parts(ca, cb, ta, tb).alias("c"))
    flat = both.where("total_a > 0 or total_b > 0").select("variable", F.posexplode(parts).alias("cell", "e"))
    named = flat.join(domain(cells, schema).select("variable", "cell", "label"), ["variable", "cell"])
    rows = named.select("variable", F.col("label").alias("category"), F.col("e.p").alias("prob_a"), F.col("e.q").alias("prob_b"), (F.col("e.q") - F.col("e.p")).alias("delta"), F.col("e.c").alias("contribution"))
    order = Window.partitionBy("variable").orderBy(F.abs("delta").desc(), "category")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Blocks of values that face each other in ``pairs``: two values meet in one of BLOCKS * (BLOCKS + 1) / 2 places.
BLOCKS = 8


def _each_value(cells: DataFrame, schema: Schema, variable: str, dimension: str, where: Where | None = None) -> DataFrame:
    """value, counts, total, entropy of every value of the dimension in the database, by one pass; null where it has no distribution."""
    schema.dimension(dimension)
    own = (F.col("variable") == variable) & _matches(schema, where or {})
    sums = cells.groupBy(F.col(f"`{dim(dimension)}`").alias("value"), F.when(own, F.col("cell")).alias("cell")).agg(F.sum(F.when(own, F.col("cnt"))).alias("cnt"))
    held = sums.groupBy("value").agg(F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "cnt")))).alias("m"), F.sum("cnt").alias("total"))
    counts = F.when(F.col("total").isNotNull(), _dense("m", F.lit(schema.variable(variable).kind.size)))
    return held.select("value", counts.alias("counts"), "total", m.entropy(counts, F.col("total")).alias("entropy"))


def pairs(cells: DataFrame, schema: Schema, variable: str, dimension: str, where: Where | None = None, diagonal: bool = False) -> DataFrame:
    """All pairs a < b (``diagonal``: a <= b) of the dimension's values in the database with their counts; null where a value has no distribution.

    Values are dealt into blocks that face each other, so that no side is held whole anywhere."""
    each = _each_value(cells, schema, variable, dimension, where).withColumn("block", F.pmod(F.hash("value"), F.lit(BLOCKS)))
    other = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))

    def side(s: str) -> DataFrame:
        met = each.withColumn("other", other)
        return met.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *(F.col(c).alias(f"{c}_{s}") for c in ("value", "counts", "total", "entropy", "block")))

    # two of one block meet where it faces itself only
    here = f"value_a {'<=' if diagonal else '<'} value_b and least(block_a, block_b) = low and greatest(block_a, block_b) = high"
    return side("a").join(side("b"), ["low", "high"]).where(here).drop("low", "high", "block_a", "block_b")


def across(cells: DataFrame, schema: Schema, variable: str, dimension: str, where: Where | None = None) -> DataFrame:
    """value_a, value_b, jsd, hellinger, psi, samples_a, samples_b of all pairs; null distances where one is missing."""
    x = _abt()
    both = F.col("total_a").isNotNull() & F.col("total_b").isNotNull()
    got = pairs(cells, schema, variable, dimension, where)
    out = got.select("value_a", "value_b", *(F.when(both, f(*x)).alias(n) for n, f in (("jsd", m.jsd), ("hellinger", m.hellinger), ("psi", m.psi))), F.when(both, F.col("total_a")).alias("samples_a"), F.when(both, F.col("total_b")).alias("samples_b"))
    return out.orderBy(F.coalesce(F.round("jsd", 6), F.lit(0.0)).desc(), "value_a", "value_b")


def explain(cells: DataFrame, schema: Schema, a: Where, b: Where, where: Where | None = None) -> DataFrame:
    """Of every variable: jsd, its fraction of the total, entropies. A variable that lacks a side has a null jsd."""
    x = _abt()
    names = [v.name for v in schema.variables]
    both = _two(cells, schema, names, a | (where or {}), b | (where or {}))
    every = cells.sparkSession.createDataFrame([(n,) for n in names], "variable string").join(both, "variable", "left")
    scored = every.select("variable", F.when(F.col("total_a").isNotNull(), m.jsd(*x)).alias("jsd"), "entropy_a", "entropy_b")
    total = F.sum("jsd").over(Window.partitionBy(F.lit(1)))  # one row for each variable
    out = scored.withColumn("total", total).withColumn("fraction", F.when(F.col("total") > 0, F.col("jsd") / F.col("total")).otherwise(F.lit(0.0)))
    return out.orderBy(F.desc("jsd"), "variable")


def track(cells: DataFrame, schema: Schema, variable: str, start: str | None = None, end: str | None = None, granularity: str | None = None, where: Where | None = None, dimension: str = "time", strict: bool = False) -> DataFrame:
    """time, entropy, samples, drift to the next point (null at the last), of the points in [start, end].

    A coarser granularity merges points first. ``strict``: the first variable and the full series, whatever is asked for."""
    own = schema.dimension(dimension)
    column = f"`{dim(dimension)}`"
    if strict:
        variable, start, end, granularity = schema.default_variable, None, None, None
    if granularity and granularity != own.granularity:
        rank = {"daily": 0, "weekly": 1, "monthly": 1, "yearly": 2}
        if granularity not in rank or own.granularity not in rank or rank[granularity] <= rank[own.granularity] or own.granularity == "weekly":
            raise SchemaError(f"{own.granularity or 'raw'} points cannot be shown as {granularity}")
        text = F.col(column)
        day = F.try_to_timestamp(F.when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text), F.lit("yyyy-MM-dd"))
        cells = cells.withColumn(dim(dimension), F.coalesce(encode.cut_time(day, granularity), text))
    rows = dist(cells, schema, [dimension], where, [variable]).withColumnRenamed(dim(dimension), "time")
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if end is not None:
        rows = rows.where(F.col("time") <= end)
    order = Window.partitionBy("variable").orderBy("time")
    after = rows.withColumns({"next_time": F.lead("time").over(order), "counts_b": F.lead("counts").over(order), "total_b": F.lead("total").over(order)})
    drift = F.when(F.col("next_time").isNotNull(), m.jsd(F.col("counts"), F.col("counts_b"), F.col("total"), F.col("total_b")))
    return after.select("time", "entropy", F.col("total").alias("samples"), "next_time", drift.alias("drift")).orderBy("time")


def drift_events(series: DataFrame) -> DataFrame:
    """The steps of a track whose drift is beyond the third quartile by 1.5 times the quartile range: time_from, time_to, jsd, threshold.

    Quartiles are by place in the sorted drifts. Where the range vanishes, the threshold is three medians."""
    steps = series.where("drift is not null")
    held = steps.agg(F.array_sort(F.collect_list("drift")).alias("s"))

    def at(numerator: int, over: int) -> Column:
        return F.try_element_at("s", (F.floor(F.size("s") * numerator / over) + 1).cast("int"))

    q = held.select(at(1, 4).alias("q1"), at(1, 2).alias("q2"), at(3, 4).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    threshold = q.select(F.when(spread < 1e-12, 3 * F.col("q2")).otherwise(F.col("q3") + 1.5 * spread).alias("threshold"))
    found = steps.join(F.broadcast(threshold), F.col("drift") > F.col("threshold")).where("threshold > 0")  # one row
    return found.select(F.col("time").alias("time_from"), F.col("next_time").alias("time_to"), F.col("drift").alias("jsd"), "threshold").orderBy("time_from")


def show(cells: DataFrame, schema: Schema, variable: str, where: Where, top: int | None = None, bottom: int | None = None) -> DataFrame:
    """cell, label, cnt, prob of all declared cells, empty ones too; with ``top`` or ``bottom`` the most or least probable."""
    one = dist(cells, schema, where=where, variables=[variable])
    flat = one.select("total", F.posexplode("counts").alias("cell", "cnt"))
    labels = domain(cells, schema).where(F.col("variable") == variable).select("cell", "label")
    out = flat.join(labels, "cell").select("cell", "label", "cnt", F.when(F.col("total") > 0, F.col("cnt") / F.col("total")).otherwise(F.lit(0.0)).alias("prob"))
    if top is not None:
        return out.orderBy(F.desc("prob"), "cell").limit(top)
    if bottom is not None:
        return out.orderBy("prob", "cell").limit(bottom)
    return out.orderBy("cell")


def rank_entropy(cells: DataFrame, schema: Schema, variable: str, dimension: str, where: Where | None = None, strict: bool = False) -> DataFrame:
    """value, entropy, samples by falling entropy. ``strict``: each stored key is a row of its own."""
    by = schema.dims if strict else [dimension]
    out = dist(cells, schema, by, where, [variable])
    return out.select(F.col(f"`{dim(dimension)}`").alias("value"), "entropy", F.col("total").alias("samples")).orderBy(F.desc("entropy"), "value")


def associations(joint: DataFrame, schema: Schema, by: list[str] = (), where: Where | None = None, pair: tuple[str, str] | None = None) -> DataFrame:
    """var_a, var_b, the values of ``by``, mi, nmi, cramers_v, samples; one shuffle on the pair and ``by``, the rest are windows of it."""
    _check(schema, by)
    if pair:
        joint = joint.where((F.col("var_a") == pair[0]) & (F.col("var_b") == pair[1]))
    keys = ["var_a", "var_b", *(f"`{dim(d)}`" for d in by)]
    n = _filter(joint, schema, where).groupBy(*keys, "x", "y").agg(F.sum("cnt").alias("n")).where("n > 0")
    of = lambda *more: F.sum("n").over(Window.partitionBy(*keys, *more))
    rows = n.withColumns({"r": of("x"), "c": of("y"), "t": of()})
    p = F.col("n") / F.col("t")
    px, py = F.col("r") / F.col("t"), F.col("c") / F.col("t")
    sums = rows.groupBy(*keys).agg(F.sum(p * F.log2(p / (px * py))).alias("mi"), F.sum(-p * F.log2(px)).alias("hx"), F.sum(-p * F.log2(py)).alias("hy"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("o2"), F.max("t").alias("samples"))
    small: Column = F.lit(0)
    for a, b in schema.joints:
        x, y = schema.axes((a, b))
        small = F.when((F.col("var_a") == a) & (F.col("var_b") == b), min(x.kind.size - 1, y.kind.size - 1)).otherwise(small)
    least = F.least("hx", "hy")
    return sums.select(*keys, "mi", F.when(least > 0, m.clamp(F.try_divide("mi", least))).otherwise(F.lit(0.0)).alias("nmi"), F.when(small > 0, m.clamp(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("o2") - 1, small))))).otherwise(F.lit(0.0)).alias("cramers_v"), "samples")


def mutual_information(joint: DataFrame, schema: Schema, a: str, b: str, where: Where) -> DataFrame:
    """One row: mi, nmi, cramers_v, samples, strength."""
    out = associations(joint, schema, where=where, pair=schema.joint(a, b))
    return out.withColumn("strength", F.when(F.col("mi") > 0.3, "strong").when(F.col("mi") > 0.1, "moderate").otherwise("weak"))


def cmi_per_value(joint: DataFrame, schema: Schema, a: str, b: str, dimension: str, where: Where | None = None) -> DataFrame:
    out = associations(joint, schema, [dimension], where, schema.joint(a, b))
    return out.select(F.col(f"`{dim(dimension)}`").alias("value"), "mi", "nmi", "cramers_v", "samples").orderBy("value")


def conditional_mutual_information(joint: DataFrame, schema: Schema, a: str, b: str, dimension: str, where: Where | None = None) -> DataFrame:
    """One row: cmi (mean of the values' mutual information, weighted by samples) and samples."""
    each = cmi_per_value(joint, schema, a, b, dimension, where)
    return each.agg(F.coalesce(F.try_divide(F.sum(F.col("mi") * F.col("samples")), F.sum("samples")), F.lit(0.0)).alias("cmi"), F.sum("samples").alias("samples")).where("samples is not null")


def correlations(joint: DataFrame, schema: Schema, dimension: str | None = None, limit: int = 20) -> DataFrame:
    """The most associated declared pairs, of each value of the dimension or of each stored key."""
    by = [dimension] if dimension else schema.dims
    out = associations(joint, schema, by)
    label = F.concat_ws("/", *(F.concat(F.lit(f"{d}:"), F.col(f"`{dim(d)}`")) for d in by)) if not dimension else F.col(f"`{dim(dimension)}`")
    if not by:
        label = F.lit("all")
    return out.select("var_a", "var_b", label.alias("key"), "mi", "nmi", "cramers_v", "samples").orderBy(F.desc("mi"), "var_a", "var_b", "key").limit(limit)


def _distance(schema: Schema, variable: str, metric: str, strict: bool = False) -> Column:
    metric = metric.lower()
    x = _abt()
    if metric == "wasserstein":
        width = _width(schema, variable)
        return m.wasserstein(*x, F.lit(width)) if width is not None else m.jsd(*x)
    if metric not in m.DISTANCES:
        if not strict:
            raise SchemaError(f"unknown metric '{metric}'")
        metric = "jsd"
    return m.DISTANCES[metric](*x)


def pairwise(cells: DataFrame, schema: Schema, variable: str, dimension: str, metric: str = "jsd") -> DataFrame:
    """value_a, value_b, distance of all ordered pairs, 0 on the diagonal: each pair is computed once."""
    same = F.col("value_a") == F.col("value_b")
    half = pairs(cells, schema, variable, dimension, diagonal=True).select("value_a", "value_b", F.when(same, 0.0).otherwise(_distance(schema, variable, metric)).alias("distance"))
    one, other = F.struct("value_a", "value_b", "distance"), F.struct(F.col("value_b").alias("value_a"), F.col("value_a").alias("value_b"), "distance")
    mirrored = half.select(F.explode(F.when(same, F.array(one)).otherwise(F.array(one, other))).alias("e")).select("e.*")
    return mirrored.orderBy("value_a", "value_b")


def pairwise_matrix(cells: DataFrame, schema: Schema, variable: str, dimension: str, metric: str = "jsd") -> DataFrame:
    return pairwise(cells, schema, variable, dimension, metric).groupBy(F.col("value_a").alias("value")).pivot("value_b").agg(F.first("distance")).orderBy("value")


def nearest(cells: DataFrame, schema: Schema, variable: str, reference: Where, dimension: str, limit: int = 3, metric: str = "jsd") -> DataFrame:
    """value, distance of the values of the dimension whose distributions are nearest to the reference's."""
    one = dist(cells, schema, where=reference, variables=[variable]).select(*(F.col(c).alias(f"{c}_a") for c in ("counts", "total")))
    others = dist(cells, schema, [dimension], variables=[variable]).select(F.col(f"`{dim(dimension)}`").alias("value"), *(F.col(c).alias(f"{c}_b") for c in ("counts", "total")))
    if dimension in reference:
        others = others.where(F.col("value") != reference[dimension])
    faced = others.join(F.broadcast(one))  # one row
    return faced.select("value", _distance(schema, variable, metric).alias("distance")).orderBy("distance", "value").limit(limit)


def dimension_values(cells: DataFrame, schema: Schema, dimension: str) -> DataFrame:
    schema.dimension(dimension)
    return cells.select(F.col(f"`{dim(dimension)}`").alias("value")).distinct().orderBy("value")


def stats(cells: DataFrame, schema: Schema) -> DataFrame:
    """distributions, total_samples (over all of them), variables, dimensions."""
    each = cells.groupBy("variable", *(f"`{dim(d)}`" for d in schema.dims)).agg(F.sum("cnt").alias("n"))
    return each.agg(F.count("*").alias("distributions"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"), F.lit(len(schema.variables)).cast("bigint").alias("variables"), F.lit(len(schema.dimensions)).cast("bigint").alias("dimensions"))


def describe(schema: Schema) -> list[tuple[str, str, str]]:
    """type, name and details of everything declared."""
    rows = []
    for v in schema.variables:
        k = v.kind
        text = f"continuous  bins={k.bins}  range={f'[{k.range[0]:g}, {k.range[1]:g}]' if k.range else ''}" if isinstance(k, Continuous) else f"categorical  cats={k.size}  unknown={str(k.allow_unknown).lower()}"
        rows.append(("variable", v.name, text))
    rows += [("dimension", d.name, f"source={d.source}  granularity={d.granularity or 'none'}") for d in schema.dimensions]
    return rows + [("joint", f"{a} × {b}", "") for a, b in schema.joints]


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """label, count_a, count_b over the union of two category counts (label, cnt), 0 where one side lacks it."""
    left, right = (x.select("label", F.col("cnt").alias(f"count_{s}")) for x, s in ((a, "a"), (b, "b")))
    return left.join(right, "label", "full_outer").select("label", *(F.coalesce(f"count_{s}", F.lit(0).cast("bigint")).alias(f"count_{s}") for s in "ab")).orderBy("label")


def changes(before: DataFrame, after: DataFrame, schema: Schema) -> DataFrame:
    """Cells whose counts differ between two states: variable, dimensions, cell, cnt_before, cnt_after."""
    keys = ["variable", *(dim(x) for x in schema.dims), "cell"]
    old, new = (x.select(*(f"`{k}`" for k in keys), F.col("cnt").alias(n)) for x, n in ((before, "cnt_before"), (after, "cnt_after")))
    zero = F.lit(0).cast("bigint")
    both = old.join(new, keys, "full_outer").select(*(f"`{k}`" for k in keys), F.coalesce("cnt_before", zero).alias("cnt_before"), F.coalesce("cnt_after", zero).alias("cnt_after"))
    return both.where("cnt_before <> cnt_after")

"""From rows to cells: the counts that everything else is computed from.

``cells``: variable, one column for each dimension (``dim_<name>``), cell, cnt. Cell -1 is the unknown
category. ``joint_cells``: var_a, var_b, the dimensions, x, y, cnt, known cells only. Both are additive:
counts of more rows are added by a union and a sum, in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encode
from ..schema import Categorical, Continuous, Schema, SchemaError


def dim(name: str) -> str:
    return f"dim_{name}"


def dim_columns(schema: Schema) -> list[str]:
    return [dim(d) for d in schema.dims]


def identity_mapping(schema: Schema) -> dict[str, str]:
    """Variable or dimension -> source column. Two dimensions may share a column."""
    return {v.name: v.name for v in schema.variables} | {d.name: d.source for d in schema.dimensions}


def _mapped(df: DataFrame, schema: Schema, mapping: dict[str, str] | None) -> dict[str, str]:
    mapping = mapping or identity_mapping(schema)
    known = {v.name for v in schema.variables} | {d.name for d in schema.dimensions}
    if extra := sorted(set(mapping) - known):
        raise SchemaError(f"not in the schema: {', '.join(extra)}")
    if not any(v.name in mapping for v in schema.variables):
        raise SchemaError("no variable is mapped")
    for d in schema.dimensions:
        if mapping.get(d.name) not in df.columns:
            raise SchemaError(f"dimension '{d.name}' has no source column")
    return mapping


def encoded(df: DataFrame, schema: Schema, mapping: dict[str, str] | None = None, keep_all: bool = False) -> tuple[DataFrame, list[str]]:
    """Dimensions as text and variables as cells (``v_<name>``, null: no count), of rows with all dimensions (or ``keep_all``); and which variables there are."""
    mapping = _mapped(df, schema, mapping)
    kinds: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    there = [v for v in schema.variables if mapping.get(v.name) in kinds]

    def of(column: str) -> Column:
        return F.col(f"`{column}`")

    dims = [encode.dimension_value(of(mapping[d]), kinds[mapping[d]], schema.dimension(d).granularity).alias(dim(d)) for d in schema.dims]
    cells = [encode.cell(of(mapping[v.name]), kinds[mapping[v.name]], v.kind).alias(f"v_{v.name}") for v in there]
    out = df.select(*dims, *cells)
    for d in dim_columns(schema) * (not keep_all):
        out = out.where(F.col(f"`{d}`").isNotNull())
    return out, [v.name for v in there]


def cells(df: DataFrame, schema: Schema, mapping: dict[str, str] | None = None, variables: list[str] | None = None) -> DataFrame:
    """Counts by variable, dimensions and cell: one pass, summed up before the shuffle. Of ``variables`` only their columns are read."""
    rows, names = encoded(df, schema, mapping)
    names = [n for n in names if variables is None or n in variables]
    dims = dim_columns(schema)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), F.col(f"`v_{n}`").alias("cell")) for n in names))).alias("e")
    long = rows.select(*_q(dims), each).select("e.variable", *_q(dims), "e.cell").where("cell is not null")
    return long.groupBy("variable", *_q(dims), "cell").agg(F.count("*").alias("cnt"))


def joint_cells(df: DataFrame, schema: Schema, mapping: dict[str, str] | None = None) -> DataFrame:
    """Counts of pairs of known cells. Rows (x) of a mixed pair are the categorical side."""
    rows, names = encoded(df, schema, mapping)
    dims = dim_columns(schema)
    pairs = []
    for a, b in schema.joints:
        x, y = (v.name for v in schema.axes((a, b)))
        if x in names and y in names:
            pairs.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"`v_{x}`").alias("x"), F.col(f"`v_{y}`").alias("y")))
    if not pairs:
        spark = df.sparkSession
        fields = [T.StructField(c, T.StringType()) for c in ("var_a", "var_b", *dims)] + [T.StructField(c, T.IntegerType()) for c in "xy"]
        return spark.createDataFrame([], T.StructType([*fields, T.StructField("cnt", T.LongType())]))
    long = rows.select(*_q(dims), F.explode(F.array(*pairs)).alias("e")).select("e.var_a", "e.var_b", *_q(dims), "e.x", "e.y").where("x >= 0 and y >= 0")
    return long.groupBy("var_a", "var_b", *_q(dims), "x", "y").agg(F.count("*").alias("cnt"))


#: What a row of ``counted`` counts.
READ, MAPPED, CELL, JOINT = range(4)


def counted(df: DataFrame, schema: Schema, mapping: dict[str, str] | None = None) -> DataFrame:
    """Cells, joint cells, rows read and rows with all dimensions, by one pass over the rows: kind, a, b, the dimensions, x, y, cnt."""
    rows, names = encoded(df, schema, mapping, keep_all=True)
    dims = dim_columns(schema)
    there = reduce(lambda a, b: a & b, (F.col(f"`{x}`").isNotNull() for x in dims), F.lit(True))

    def entry(kind: int, a: str | None, b: str | None, x: Column, y: Column) -> Column:
        text = lambda v: F.lit(v).cast("string")
        return F.struct(F.lit(kind).alias("kind"), text(a).alias("a"), text(b).alias("b"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    none = F.lit(None)
    each = [entry(READ, None, None, none, none), F.when(there, entry(MAPPED, None, None, none, none))]
    each += [F.when(there & F.col(f"`v_{n}`").isNotNull(), entry(CELL, n, None, F.col(f"`v_{n}`"), none)) for n in names]
    for a, b in schema.joints:
        x, y = (v.name for v in schema.axes((a, b)))
        if x in names and y in names:
            x, y = F.col(f"`v_{x}`"), F.col(f"`v_{y}`")
            each.append(F.when(there & (x >= 0) & (y >= 0), entry(JOINT, a, b, x, y)))
    long = rows.select(*_q(dims), F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e"))
    own = [F.when(F.col("e.kind") >= CELL, F.col(f"`{x}`")).alias(x) for x in dims]
    return long.select("e.kind", "e.a", "e.b", *own, "e.x", "e.y").groupBy("kind", "a", "b", *_q(dims), "x", "y").agg(F.count("*").alias("cnt"))


def split(counts: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """The cells and the joint cells of ``counted``."""
    dims = _q(dim_columns(schema))
    one, two = counts.where(F.col("kind") == CELL), counts.where(F.col("kind") == JOINT)
    return one.select(F.col("a").alias("variable"), *dims, F.col("x").alias("cell"), "cnt"), two.select(F.col("a").alias("var_a"), F.col("b").alias("var_b"), *dims, "x", "y", "cnt")


def _q(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def added(*frames: DataFrame) -> DataFrame:
    """Cells of several ingests as one."""
    both = reduce(lambda a, b: a.unionByName(b), frames)
    keys = [c for c in both.columns if c != "cnt"]
    return both.groupBy(*_q(keys)).agg(F.sum("cnt").alias("cnt"))


#: Distinct values at most of a dimension of years.
MOST_YEARS = 200


def _several(text: Column, most: int) -> Column:
    """How many distinct values there are, exact up to ``most``, and more than that where there are more.

    A sketch keeps the hashes themselves while they are fewer than its size, so a task holds these and not its values, nor a row for each of its columns."""
    bits = max(12, most.bit_length())
    if bits > 26:
        return F.count_distinct(text)
    # an empty text would be left out
    return F.theta_sketch_estimate(F.theta_sketch_agg(F.concat(F.lit("="), text), bits))


def infer_schema(df: DataFrame, sample_size: int | None = 1000, max_categories: int = 50, date_columns: tuple[str, ...] = (), date_granularity: str = "daily", infer_joints: bool = False) -> Schema:
    """Variables and dimensions from the first rows (None: all rows), in one aggregation over all columns.

    Named date columns are dimensions. Columns of numbers only are continuous (20 bins over their range and a
    margin), or dimensions if they look like years. Others are dimensions if all values look like dates, or
    there are too many, and else categorical, in the order in which values are first seen. Empty ones are left out.
    Distinct values are counted only as far as that matters. The values of categorical columns, ``max_categories`` each at most, are fetched by a second aggregation."""
    schema = Schema()
    sample = (df if sample_size is None else df.limit(sample_size)).withColumn("_at", F.monotonically_increasing_id())
    flat = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    wanted = []
    for i, f in enumerate(flat):
        col = F.col(f"`{f.name}`")
        text = col.cast("string")
        number = F.when(F.lit(isinstance(f.dataType, T.NumericType)) | F.lower(text).rlike(encode.NUMBER), text.try_cast("double"))
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
        wanted += [
            F.count(col).alias(f"n{i}"), F.coalesce(F.bool_and(F.when(col.isNotNull(), finite)), F.lit(False)).alias(f"num{i}"),
            F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.coalesce(F.bool_and(F.when(col.isNotNull(), number == F.floor(number))), F.lit(False)).alias(f"int{i}"),
            _several(text, max(max_categories, MOST_YEARS)).alias(f"d{i}"), F.coalesce(F.bool_and(F.when(col.isNotNull(), F.trim(text).rlike(encode.DATE_PREFIX))), F.lit(False)).alias(f"date{i}"),
        ]
    got = sample.agg(*wanted).first() if wanted else {}
    named = [i for i, f in enumerate(flat) if f.name not in date_columns and got[f"n{i}"] and not got[f"num{i}"] and not got[f"date{i}"] and got[f"d{i}"] <= max_categories]
    cats: dict[int, list[str]] = {i: [] for i in named}
    if named:
        values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{flat[i].name}`").cast("string").alias("v")) for i in named)))
        first = sample.select("_at", values.alias("e")).where("e.v is not null").groupBy("e.i", "e.v").agg(F.min("_at").alias("at"))
        for r in sorted(first.collect(), key=lambda r: r["at"]):
            cats[r["i"]].append(r["v"])
    for i, f in enumerate(flat):
        if f.name in date_columns:
            schema.define_dimension(f.name, granularity=date_granularity)
        elif not got[f"n{i}"]:
            continue
        elif got[f"num{i}"]:
            lo, hi = got[f"lo{i}"], got[f"hi{i}"]
            if got[f"int{i}"] and lo >= 1900 and hi <= 2100 and got[f"d{i}"] <= MOST_YEARS:
                schema.define_dimension(f.name)
            else:
                schema.define_variable(f.name, Continuous(20, (lo, hi + (1.0 if hi == lo else (hi - lo) * 0.001))))
        elif got[f"date{i}"] or got[f"d{i}"] > max_categories:
            schema.define_dimension(f.name, granularity=date_granularity if got[f"date{i}"] else None)
        else:
            schema.define_variable(f.name, Categorical(tuple(cats[i]), True))
    if infer_joints:
        names = [v.name for v in schema.variables]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                schema.define_joint(a, b)
    return schema

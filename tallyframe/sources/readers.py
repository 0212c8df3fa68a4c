"""Scans by file extension, and records from memory."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """csv, json / jsonl and parquet; anything else is an error."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("json", "jsonl"):
        return read_json(spark, path, schema)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported ingestion format: '{suffix}'")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header is required, every field is text, empty fields are empty text, ragged rows fail."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path).na.fill("")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines and lines of other JSON values are left out, malformed objects fail."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if schema is not None:
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        df = reader.schema(T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])).json(path)
    else:
        df = reader.json(path)
    if "_corrupt" not in df.columns:
        return df
    other = F.col("_corrupt").rlike(r"^\s*[^{\s]")
    bad = F.col("_corrupt").isNotNull()
    # raise_error only runs for rows that it is asked of
    checked = F.when(bad & ~other, F.raise_error(F.concat(F.lit("malformed JSON line: "), F.col("_corrupt"))).cast("boolean")).otherwise(~bad)
    return df.where(checked).drop("_corrupt")


def from_records(spark: SparkSession, records: list[dict[str, Any]]) -> DataFrame:
    """Rows of a list of dictionaries; a key that some lack is null there. Columns of mixed types become text."""
    names: dict[str, set[type]] = {}
    for r in records:
        for k, v in r.items():
            names.setdefault(k, set()).add(type(v))
    kinds: dict[str, T.DataType] = {}
    for k, seen in names.items():
        seen = seen - {type(None)}
        kinds[k] = T.BooleanType() if seen == {bool} else T.LongType() if seen == {int} else T.DoubleType() if seen and seen <= {int, float} else T.StringType()
    rows = []
    for r in records:
        row = []
        for k, kind in kinds.items():
            v = r.get(k)
            if v is not None and isinstance(kind, T.StringType):
                v = ("true" if v else "false") if isinstance(v, bool) else str(v)
            elif v is not None and isinstance(kind, T.DoubleType):
                v = float(v)
            row.append(v)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, kind) for k, kind in kinds.items()]))

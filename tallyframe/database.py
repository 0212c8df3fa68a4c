"""The front door: define, ingest, ask."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import distributions as d
from .operators import ingest as g
from .plans.dsl import Ref, Statement, parse
from .plans.render import QueryResult
from .schema import Categorical, Continuous, Schema, SchemaError
from .sources import readers
from .store import Meta, Store, table_sum


#: Answers that a stored database remembers.
CACHED = 10_000


@dataclass(frozen=True)
class IngestReport:
    total_rows: int
    processed: int
    skipped: int
    distributions_updated: int
    seconds: float


class ReadOnly(PermissionError):
    """The database was opened for reading."""


class Database:
    """Distributions of one schema, in memory (no path) or in a folder. Every change is committed at once."""

    def __init__(self, spark: SparkSession, path: str | None = None, mode: str = "rw", raw_log: bool = False):
        if mode not in ("ro", "rw"):
            raise ValueError("mode is 'ro' or 'rw'")
        self.spark, self.mode = spark, mode
        self.store = Store(spark, path) if path else None
        if self.store and self.store.exists():
            self.meta = self.store.read_meta()
        elif self.store and mode == "ro":
            raise FileNotFoundError(path)
        else:
            self.meta = Meta(Schema(), raw_log=raw_log)
            if self.store:
                self.store.write_meta(self.meta)
        self._memory: tuple[DataFrame, DataFrame, DataFrame] | None = None
        self._seen: dict[str, DataFrame] = {}
        self._cache: OrderedDict[tuple[str, str, str], QueryResult] = OrderedDict()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._memory = None

    # ------------------------------------------------------------ definitions

    @property
    def schema(self) -> Schema:
        return self.meta.schema

    def _changes(self) -> None:
        if self.mode == "ro":
            raise ReadOnly("opened read-only")

    def _defined(self) -> Database:
        if self.store:
            self.store.write_meta(self.meta)
        return self

    def define_variable(self, name: str, kind: Continuous | Categorical) -> Database:
        self._changes()
        self.schema.define_variable(name, kind)
        return self._defined()

    def define_dimension(self, name: str, source: str | None = None, granularity: str | None = None) -> Database:
        self._changes()
        if self._tables():
            raise SchemaError("dimensions are fixed once there are rows")
        self.schema.define_dimension(name, source, granularity)
        return self._defined()

    def define_joint(self, a: str, b: str) -> Database:
        self._changes()
        self.schema.define_joint(a, b)
        return self._defined()

    # ------------------------------------------------------------ tables

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        if self.store:
            if not self.meta.version:
                return None
            return tuple(self.store.read(self.meta, t) for t in ("cells", "joint_cells", "versions"))
        return self._memory

    @property
    def cells(self) -> DataFrame:
        return self._some()[0]

    @property
    def joint_cells(self) -> DataFrame:
        return self._some()[1]

    def _some(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        tables = self._tables()
        if tables is None:
            raise d.NotFound("nothing was ingested yet")
        return tables

    # ------------------------------------------------------------ ingest

    def ingest(self, df: DataFrame, mapping: dict[str, str] | None = None, *, stream: tuple[str, int] | None = None, mark: tuple[str, str | None, DataFrame] | None = None) -> IngestReport:
        """Adds the rows of df, in one pass over them. A version of a distribution is the number of ingests that touched it.

        ``stream``: (name, batch); a batch that is in already is left out. ``mark``: (source, highest value
        read, the rows there). Nothing has changed if it fails, here or on disk, so that it can be tried again."""
        self._changes()
        began = time.time()
        if stream and self.meta.batches.get(stream[0], -1) >= stream[1]:
            return IngestReport(0, 0, 0, 0, 0.0)
        keys = [f"`{k}`" for k in ("variable", *g.dim_columns(self.schema))]
        # few rows, whatever they count
        counts = g.counted(df, self.schema, mapping).persist()
        try:
            sums = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("cnt").alias("n")).where(F.col("kind") < g.CELL).collect()}
            total, processed = sums.get(g.READ, 0), sums.get(g.MAPPED, 0)
            new, joints = g.split(counts, self.schema)
            touched = new.select(*keys).distinct().withColumns({"version": F.lit(1).cast("bigint"), "last_updated": F.current_timestamp()})
            updated = touched.count()
            meta = self.meta.copy()
            if stream:
                meta.batches[stream[0]] = stream[1]
            if mark:
                meta.marks[mark[0]] = mark[1]
            if self.store:
                self.store.commit(meta, new, joints, touched, raw=df if meta.raw_log else None, seen=(mark[0], mark[2]) if mark else None, add=True)
            else:
                result = zip(("cells", "joint_cells", "versions"), (new, joints, touched), strict=True)
                held = tuple(self._held(table_sum(n, *([self._memory[i]] if self._memory else []), r)) for i, (n, r) in enumerate(result))
                seen = {mark[0]: self._held(mark[2])} if mark else {}
                self._memory = held
                self._seen |= seen
            self.meta = meta
        finally:
            counts.unpersist()
        return IngestReport(total, processed, total - processed, updated, time.time() - began)

    def _held(self, df: DataFrame) -> DataFrame:
        """Counts without their lineage: they are few, whatever they count."""
        return self.spark.createDataFrame(df.toArrow(), df.schema)

    def ingest_file(self, path: str, mapping: dict[str, str] | None = None) -> IngestReport:
        return self.ingest(readers.read(self.spark, path), mapping)

    def ingest_auto(self, path: str, max_categories: int = 50, date_columns: tuple[str, ...] = (), date_granularity: str = "daily", infer_joints: bool = False) -> IngestReport:
        """Infers what is not defined yet, then ingests."""
        return self._auto(readers.read(self.spark, path), max_categories, date_columns, date_granularity, infer_joints)

    def ingest_records(self, records: list[dict[str, Any]]) -> IngestReport:
        df = readers.from_records(self.spark, records)
        return self.ingest(df) if self.schema.variables else self._auto(df)

    def _auto(self, df: DataFrame, max_categories: int = 50, date_columns: tuple[str, ...] = (), date_granularity: str = "daily", infer_joints: bool = False) -> IngestReport:
        self._changes()
        found = g.infer_schema(df, max_categories=max_categories, date_columns=tuple(date_columns), date_granularity=date_granularity, infer_joints=infer_joints)
        have = {v.name for v in self.schema.variables} | {x.name for x in self.schema.dimensions}
        for v in found.variables:
            if v.name not in have:
                self.define_variable(v.name, v.kind)
        for x in found.dimensions:
            if x.name not in have:
                self.define_dimension(x.name, x.source, x.granularity)
        for a, b in found.joints:
            self.define_joint(a, b)
        return self.ingest(df)

    def ingest_delta(self, path: str, order_by: str, mapping: dict[str, str] | None = None) -> IngestReport:
        """Rows of a growing source beyond those read before, in the order of ``order_by``, of any type that has one.

        The mark is its highest value among rows read, kept with the data. Rows at the mark, and rows without a value, may
        still come: those that were there are listed by hash, with their number, and only more of them are new."""
        df = readers.read(self.spark, path)
        order, kind = F.col(f"`{order_by}`"), df.schema[order_by].dataType
        text, more = order.cast("string"), self.meta.marks.get(path)
        mark = F.lit(more).cast(kind)
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        hashed = {"_h1": F.xxhash64(F.to_json(row)), "_h2": F.hash(F.to_json(row))}
        past = self.store.read_seen(self.meta, path) if self.store else self._seen.get(path)
        new = df
        if past is not None:
            ahead = df.where(order > mark) if more is not None else df.where(order.isNotNull())
            level = df.where(order.isNull() | (order == mark) if more is not None else order.isNull()).withColumns(hashed)
            level = level.withColumn("_n", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy(F.lit(1))))
            level = level.join(past, ["_h1", "_h2"], "left").where("_n > coalesce(_seen, 0)").select(*(f"`{c}`" for c in df.columns))
            new = ahead.unionByName(level)
        top = df.agg(F.max(order).cast("string").alias("m")).first()["m"]
        top = more if top is None else top
        there = df.where(order.isNull() | (text == top) if top is not None else order.isNull()).withColumns(hashed)
        return self.ingest(new, mapping, mark=(path, top, there.groupBy("_h1", "_h2").agg(F.count("*").alias("_seen"))))

    # ------------------------------------------------------------ snapshots

    def snapshot(self) -> None:
        """Keeps the cells as they are now."""
        self._changes()
        if not self.store:
            raise ValueError("snapshots need a path")
        self.store.append_snapshot(self.meta, self.cells)
        self.store.write_meta(self.meta)

    def snapshots(self) -> DataFrame | None:
        return self.store.read_snapshots(self.meta) if self.store else None

    def update_cells(self, delta: DataFrame) -> None:
        """Adds a table like ``cells``, after a snapshot."""
        self._changes()
        if self.store:
            self.store.append_snapshot(self.meta, self.cells)
        old, joints, versions = self._some()
        result = g.added(old, delta.select(*(f"`{c}`" for c in old.columns))), joints, versions
        if self.store:
            self.store.commit(self.meta, *result)
        else:
            self._memory = tuple(self._held(r) for r in result)

    # ------------------------------------------------------------ questions

    def query(self, text: str) -> QueryResult:
        """The statement's table. Tables are remembered until the database changes, the CACHED last asked for."""
        key = (self.meta.version, self.meta.schema.to_json(), text)
        if self.store is None or key not in self._cache:
            result = self.execute(parse(text))
            if self.store is None or not self.meta.version:
                return result
            self._cache[key] = result
            if len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        self._cache.move_to_end(key)
        kept = self._cache[key]
        return QueryResult(list(kept.header), [list(r) for r in kept.rows])

    def execute(self, s: Statement) -> QueryResult:
        return getattr(self, f"_{s.kind}")(s)

    def _where(self, refs: tuple[Ref, ...]) -> dict[str, str]:
        return {r.dimension: r.value for r in refs}

    def _one(self, df: DataFrame, what: str):
        row = df.first()
        if row is None:
            raise d.NotFound(what)
        return row

    def _movers(self, variables: list[str], a: dict, b: dict, limit: int) -> list:
        chosen = [v for v in variables if isinstance(self.schema.variable(v).kind, Categorical)]
        return d.movers(self.cells, self.schema, chosen, a, b, limit).orderBy("variable", "rank").collect() if chosen else []

    def _compare(self, s: Statement) -> QueryResult:
        (a, va), (b, vb), where = s.a.parse(), s.b.parse(), self._where(s.where)
        v = s.variable or va or vb or self.schema.default_variable
        r = self._one(d.compare(self.cells, self.schema, v, a, b, where), f"no distribution of '{v}' on both sides")
        rows = [
            ["JSD", f"{r['jsd']:.6f}"], ["PSI", f"{r['psi']:.6f}"], ["Hellinger", f"{r['hellinger']:.6f}"], ["KL(A→B)", f"{r['kl_a_to_b']:.6f}"], ["KL(B→A)", f"{r['kl_b_to_a']:.6f}"],
            ["Entropy(A)", f"{r['entropy_a']:.4f} bits"], ["Entropy(B)", f"{r['entropy_b']:.4f} bits"], ["Samples", f"{r['samples_a']} vs {r['samples_b']}"], ["95% CI", f"[{r['ci_lower']:.4f}, {r['ci_upper']:.4f}]"],
        ]
        if r["wasserstein"] is not None:
            rows.append(["Wasserstein", f"{r['wasserstein']:.6f}"])
        if top := self._movers([v], a | where, b | where, 10):
            rows += [["", ""], ["--- Top Movers ---", ""]]
            rows += [[x["category"], f"{x['delta']:+.4f}  ({x['prob_a']:.3f} → {x['prob_b']:.3f})  contrib={x['contribution']:.4f}"] for x in top]
        return QueryResult(["Metric", "Value"], rows)

    def _across(self, s: Statement) -> QueryResult:
        got = d.across(self.cells, self.schema, s.variable, s.dimension, self._where(s.where)).collect()
        if not got:
            raise d.NotFound(f"dimension '{s.dimension}' has fewer than 2 values")
        rows = [[r["value_a"], r["value_b"], *(["N/A"] * 4 if r["jsd"] is None else [f"{r['jsd']:.6f}", f"{r['hellinger']:.6f}", f"{r['psi']:.6f}", f"{r['samples_a']} vs {r['samples_b']}"])] for r in got]
        return QueryResult(["Value A", "Value B", "JSD", "Hellinger", "PSI", "Samples"], rows)

    def _explain(self, s: Statement) -> QueryResult:
        (a, _), (b, _) = s.a.parse(), s.b.parse()
        got = d.explain(self.cells, self.schema, a, b).collect()
        if missing := [r["variable"] for r in got if r["jsd"] is None]:
            raise d.NotFound(f"no distribution of '{missing[0]}' on both sides")
        top: dict[str, list] = {}
        for x in self._movers([v.name for v in self.schema.variables], a, b, 5):
            top.setdefault(x["variable"], []).append(x)
        rows = [["TOTAL", f"{got[0]['total']:.6f}" if got else "0.000000", "100.0%", "", ""]]
        for r in got:
            rows.append([r["variable"], f"{r['jsd']:.6f}", f"{r['fraction'] * 100:.1f}%", f"{r['entropy_a']:.4f}", f"{r['entropy_b']:.4f}"])
            rows += [[f"  {x['category']}", f"{x['delta']:+.4f}", f"contrib={x['contribution']:.4f}", "", ""] for x in top.get(r["variable"], [])]
        return QueryResult(["Variable", "JSD", "Fraction", "H(A)", "H(B)"], rows)

    def _track(self, s: Statement) -> QueryResult:
        key, named = s.a.parse()
        time_from = key.pop("time", None)
        series = d.track(self.cells, self.schema, named or s.variable, start=time_from, granularity=s.granularity, where=key)
        got = series.collect()
        rows = []
        for r in got:
            drift = r["drift"] or 0.0
            rows.append([r["time"], f"{r['entropy']:.4f}", f"{drift:.4f}{' ← shift' if drift > 0.05 else ''}"])
        events = d.drift_events(series).collect()
        if events:
            rows.append(["", "", ""])
            rows += [[f"{e['time_from']} → {e['time_to']}", f"JSD={e['jsd']:.4f}", f"drift above {e['threshold']:.4f}"] for e in events]
        return QueryResult(["Time", "Entropy", "Drift (JSD)"], rows)

    def _show(self, s: Statement) -> QueryResult:
        key, _ = s.a.parse()
        where = key | self._where(s.where)
        one = self._one(d.dist(self.cells, self.schema, where=where, variables=[s.variable]), "distribution not found")
        versions = self._some()[2].where(F.col("variable") == s.variable)
        for k, v in where.items():
            versions = versions.where(F.col(f"`{g.dim(k)}`") == v)
        version = versions.agg(F.max("version")).first()[0]
        cells = d.show(self.cells, self.schema, s.variable, where, **({s.order: s.limit} if s.order else {})).collect()
        rows = [["Entropy", f"{one['entropy']:.4f} bits"], ["Samples", str(one["total"])], ["Version", str(version)], ["", ""]]
        rows += [[c["label"], f"{c['cnt']:6d}  {c['prob']:.4f}  {'#' * int(c['prob'] * 40)}"] for c in cells]
        return QueryResult(["Category/Bin", "Count / Prob"], rows)

    def _rank(self, s: Statement) -> QueryResult:
        got = d.rank_entropy(self.cells, self.schema, s.variable, s.dimension, self._where(s.where)).collect()
        return QueryResult([s.dimension, "Entropy", "Samples", ""], [[r["value"], f"{r['entropy']:.4f} bits", str(r["samples"]), "#" * int(r["entropy"] * 8)] for r in got])

    def _mi(self, s: Statement) -> QueryResult:
        key, _ = s.a.parse()
        r = self._one(d.mutual_information(self.joint_cells, self.schema, s.variable, s.other, key), "joint distribution not found")
        rows = [["MI", f"{r['mi']:.4f} bits"], ["NMI", f"{r['nmi']:.4f}"], ["Cramér's V", f"{r['cramers_v']:.4f}"], ["Samples", str(r["samples"])], ["Strength", r["strength"]]]
        return QueryResult(["Metric", "Value"], rows)

    def _cmi(self, s: Statement) -> QueryResult:
        args = (self.joint_cells, self.schema, s.variable, s.other, s.dimension)
        one = self._one(d.conditional_mutual_information(*args), "joint distribution not found")
        rows = [["CMI", f"{one['cmi']:.4f} bits", "", ""], ["Total samples", str(one["samples"]), "", ""], ["", "", "", ""]]
        rows += [[r["value"], f"{r['mi']:.4f}", f"{r['nmi'] * 100:.1f}%", str(r["samples"])] for r in d.cmi_per_value(*args).collect()]
        return QueryResult([s.dimension, "MI", "NMI", "Samples"], rows)

    def _correlations(self, s: Statement) -> QueryResult:
        got = d.correlations(self.joint_cells, self.schema, s.dimension, s.limit).collect()
        rows = [[f"{r['var_a']} × {r['var_b']}", r["key"], f"{r['mi']:.4f}", f"{r['nmi'] * 100:.1f}%", f"{r['cramers_v']:.4f}", str(r["samples"])] for r in got]
        return QueryResult(["Pair", "Dim", "MI", "NMI", "Cramér's V", "Samples"], rows)

    def _pairwise(self, s: Statement) -> QueryResult:
        got = {(r["value_a"], r["value_b"]): r["distance"] for r in d.pairwise(self.cells, self.schema, s.variable, s.dimension, s.metric).collect()}
        names = sorted({a for a, _ in got})
        if missing := [p for p, x in got.items() if x is None]:
            raise d.NotFound(f"no distribution of '{s.variable}' for {missing[0]}")
        return QueryResult(["", *names], [[a, *("—" if a == b else f"{got[a, b]:.4f}" for b in names)] for a in names])

    def _nearest(self, s: Statement) -> QueryResult:
        key, named = s.a.parse()
        v = named or self.schema.default_variable
        got = d.nearest(self.cells, self.schema, v, key, s.dimension, s.limit, s.metric).collect()
        return QueryResult([s.dimension, s.metric.upper()], [[r["value"], f"{r['distance']:.6f}"] for r in got])

    def _export(self, s: Statement) -> QueryResult:
        inner = self.execute(s.inner)
        return QueryResult(["Output"], [[inner.to_csv() if s.format == "csv" else inner.to_json()]])

    def _stats(self, s: Statement | None = None) -> QueryResult:
        if self._tables() is None:
            got = {"distributions": 0, "total_samples": 0, "variables": len(self.schema.variables), "dimensions": len(self.schema.dimensions)}
        else:
            got = d.stats(self.cells, self.schema).first().asDict()
        return QueryResult(["Stat", "Value"], [[n, str(got[k])] for n, k in (("Distributions", "distributions"), ("Total samples", "total_samples"), ("Variables", "variables"), ("Dimensions", "dimensions"))])

    def _schema(self, s: Statement) -> QueryResult:
        return QueryResult(["Type", "Name", "Details"], [list(r) for r in d.describe(self.schema)])

    def _dimensions(self, s: Statement) -> QueryResult:
        if s.dimension:
            return QueryResult([s.dimension], [[r["value"]] for r in d.dimension_values(self.cells, self.schema, s.dimension).collect()])
        return QueryResult(["Dimension", "Cardinality"], [[x.name, f"{d.dimension_values(self.cells, self.schema, x.name).count()} values"] for x in self.schema.dimensions])

    def stats(self) -> dict[str, int]:
        return {r[0].lower().replace(" ", "_"): int(r[1]) for r in self._stats().rows}

"""The database as eight plain tools (name, arguments, text back), for programs that call tools by name."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .database import Database

HELP = """COMPARE v BETWEEN d:x AND d:y [WHERE d:z AND ...]    COMPARE v ACROSS d [WHERE ...]
EXPLAIN d:x VS d:y                                   TRACK v FROM time:x [GRANULARITY g]
SHOW v AT d:x [WHERE ...] [TOP n | BOTTOM n]         RANK v BY ENTROPY OVER d [WHERE ...]
MI a, b AT d:x                                       CMI a, b GIVEN d
CORRELATIONS [OVER d] [LIMIT n]                      PAIRWISE d ON v [USING jsd|hellinger|psi|wasserstein]
NEAREST d:x ON d [LIMIT n] [USING jsd|hellinger|psi] EXPORT statement AS CSV|JSON
STATS                                                SCHEMA
DIMENSIONS [d]"""


class Tools:
    def __init__(self, spark: SparkSession):
        self.spark, self.db = spark, None

    def names(self) -> list[str]:
        return ["help", "query", "schema", "stats", "open_database", "create_database", "ingest_file", "list_dimensions"]

    def call(self, name: str, **args: str) -> str:
        if name not in self.names():
            raise ValueError(f"no tool '{name}'")
        return getattr(self, name)(**args)

    def _open(self) -> Database:
        if self.db is None:
            raise ValueError("no database is open")
        return self.db

    def help(self) -> str:
        return HELP

    def query(self, q: str) -> str:
        return self._open().query(q).to_json()

    def schema(self) -> str:
        return self._open().query("SCHEMA").to_json()

    def stats(self) -> str:
        return json.dumps(self._open().stats())

    def open_database(self, path: str, mode: str = "ro") -> str:
        self.db = Database(self.spark, path, mode)
        return self.stats()

    def create_database(self, path: str) -> str:
        self.db = Database(self.spark, path)
        return self.stats()

    def ingest_file(self, path: str) -> str:
        report = self._open().ingest_auto(path)
        return json.dumps({"total_rows": report.total_rows, "processed": report.processed, "skipped": report.skipped})

    def list_dimensions(self) -> str:
        return self._open().query("DIMENSIONS").to_json()

"""python -m tallyframe.cli DATABASE [STATEMENT]: answers one statement, or reads them from a prompt until quit."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .database import Database
from .plans.dsl import QueryError


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = Database(spark, args[0], mode="ro")
    if args[1:]:
        print(db.query(" ".join(args[1:])))
        return 0
    while (line := input("> ").strip()).lower() not in ("quit", "exit"):
        try:
            print(db.query(line)) if line else None
        except (QueryError, LookupError, ValueError) as e:
            print(f"error: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

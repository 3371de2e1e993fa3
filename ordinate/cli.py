"""python -m ordinate.cli gen PATH N | cat PATH... | count PATH... | check PATH..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.checks import is_sorted
from .sources.generate import increasing_ranges


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """The exit status; of ``check``, the number of tables that aren't sorted."""
    if len(arguments) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("ordinate").getOrCreate()
    what, *paths = arguments
    if what == "gen":
        increasing_ranges(spark, int(paths[1]), 0).write.mode("overwrite").parquet(paths[0])
        return 0
    failures = 0
    for path in paths:
        table = spark.read.parquet(path)
        if what == "cat":
            for row in table.toLocalIterator():
                print(*row)
        elif what == "count":
            print(path, table.count())
        elif what == "check":
            keys = [c for c in table.columns if c != "tid"]
            good = is_sorted(table, keys)
            print(path, "sorted" if good else "not sorted")
            failures += not good
        else:
            print(__doc__, file=sys.stderr)
            return 2
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""What a plan did: rows and bytes, from the SQL metrics of an executed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def run(df: DataFrame) -> int:
    """Runs the plan without keeping its rows, and counts them."""
    from .distinct import counted

    watched, seen = counted(df)
    watched.write.format("noop").mode("overwrite").save()
    return seen.get["count"]


def _nodes(plan) -> Iterator:
    """The nodes of an executed plan, through adaptive stages and reused exchanges."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif kind != "ReusedExchangeExec":
        yield plan
        children = plan.children()
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


def run_metrics(df: DataFrame) -> DataFrame:
    """Runs the plan and returns one row of its SQL metrics: ``rows`` that came
    out, ``rows_written`` to and ``rows_read`` from shuffles, ``bytes_written`` to
    them and ``bytes_spilled`` by sorts and aggregates."""
    query = df._jdf.queryExecution()
    rows = query.toRdd().count()
    wanted = {"shuffleRecordsWritten": "rows_written", "recordsRead": "rows_read", "shuffleBytesWritten": "bytes_written", "spillSize": "bytes_spilled"}
    sums = dict.fromkeys(wanted.values(), 0)
    for node in _nodes(query.executedPlan()):
        metrics = node.metrics()
        for key, name in wanted.items():
            if metrics.contains(key):
                sums[name] += metrics.apply(key).value()
    return df.sparkSession.createDataFrame([(rows, *sums.values())], ", ".join(f"{n} long" for n in ("rows", *sums)))


def plan_nodes(df: DataFrame) -> list[str]:
    """Names of the physical plan's nodes, before adaptive changes."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" +-:*|()0123456789").split("(")[0].split(" ")[0] for line in text.splitlines() if line.strip()]


def columns_hashed(rows: int, keys: int) -> int:
    """Key columns that hashing ``rows`` rows looks at."""
    return rows * keys

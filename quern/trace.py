"""Timings and row counts of a query's operators, from Spark's own metrics of the plan that ran."""

from __future__ import annotations

from pyspark.sql import DataFrame


def traced(df: DataFrame) -> list[dict]:
    """Run ``df`` without keeping its rows; depth, operator and metrics (those that counted anything) of each node of the final plan."""
    execution = df.select("*")._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.execute().count()
    out: list[dict] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        if name.endswith("QueryStage"):
            return walk(node.plan(), depth)
        metrics, it = {}, node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            if (value := pair._2().value()) > 0:
                metrics[pair._2().name().get() if pair._2().name().isDefined() else pair._1()] = value
        out.append({"depth": depth, "operator": name, "metrics": metrics})
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next(), depth + 1)

    walk(plan, 0)
    return out

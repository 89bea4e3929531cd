"""Question routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import fixed
from quernel.functions.text import matches


def classify(questions: DataFrame, routes: dict[str, str] = fixed.ROUTES) -> DataFrame:
    """Adds ``route``: the first whose pattern occurs, else general."""
    route = None
    for name, pattern in routes.items():
        hit = matches(F.col("question"), pattern)
        route = F.when(hit, name) if route is None else route.when(hit, name)
    return questions.withColumn("route", route.otherwise(fixed.DEFAULT_ROUTE))


def route_flags(routed: DataFrame, has_facts: str | None = None) -> DataFrame:
    """Adds what a route needs; retrieval also runs where no facts came out."""
    out = routed.withColumn("needs_facts", F.col("route").isin("count", "replacement")).withColumn("needs_docs", F.col("route").isin("docs", "general", "location"))
    facts = F.lit(False) if has_facts is None else F.coalesce(F.col(has_facts), F.lit(False))
    return out.withColumn("runs_retrieval", F.col("needs_docs") | ~(F.col("needs_facts") & facts))

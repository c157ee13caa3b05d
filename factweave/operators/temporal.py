"""Versions of facts: each key's version holds until the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(facts: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """facts with created_at, invalid_at and previous (the tie value of the version before)."""
    w = Window.partitionBy(*key).orderBy(at, tie)
    return facts.withColumns({"created_at": F.col(at), "invalid_at": F.lead(at).over(w), "previous": F.lag(tie).over(w), "next": F.lead(tie).over(w)})


def fold(history: DataFrame, key: str, order: str, budget: int, role: str | None = None) -> DataFrame:
    """history (text) with its tokens and kept: the newest turns within budget, one at least.

    With role, a system turn ends the tail, and a reply that begins it keeps the question before it.
    """
    from factweave.functions.text import approx_tokens

    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = history.withColumn("tokens", approx_tokens(F.col("text")))
    df = df.withColumn("running", F.sum("tokens").over(w)).withColumn("recent", F.count(F.lit(1)).over(w))
    kept = (F.col("running") <= budget) | (F.col("recent") == 1)
    if role is None:
        return df.withColumn("kept", kept).drop("recent")
    df = df.withColumn("_ended", F.max((F.col(role) == "system").cast("int")).over(w)).withColumn("kept", kept & (F.col("_ended") == 0))
    back = Window.partitionBy(key).orderBy(order)
    answers = (F.col(role) == "user") & F.lead("kept").over(back) & (F.lead(role).over(back) == "assistant")
    return df.withColumn("kept", F.col("kept") | F.coalesce(answers & ~F.col("kept"), F.lit(False))).drop("recent", "_ended")

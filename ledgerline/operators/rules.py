"""Ordered rules: the first that fits decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def cascade(rules: Sequence[Rule], default: str | None = None) -> Column:
    """The label of the first rule whose condition holds."""
    chain = None
    for label, condition in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    last = F.lit(default).cast("string")
    return last if chain is None else chain.otherwise(last)


def text_cascade(text: Column, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the text (ignoring case)."""
    return cascade([(label, F.lower(text).rlike(pattern)) for label, pattern in patterns], default)


@dataclass
class FilterCascade:
    """Rows pass if no rule fits; rejected rows carry the first rule that did.

    ``apply`` marks each row once; what is kept, rejected and lost are projections of that one frame.
    """

    rules: Sequence[Rule]
    reason: str = "filter_reason"
    marked: DataFrame | None = field(default=None, repr=False)

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.marked = df.withColumn(self.reason, cascade(self.rules))
        return self.marked.where(F.col(self.reason).isNull()).drop(self.reason), self.marked.where(F.col(self.reason).isNotNull())

    def counts(self) -> DataFrame:
        """Rows by reason; null is kept."""
        return self.marked.groupBy(self.reason).agg(F.count("*").alias("n"))

    def attrition(self, entity: str) -> DataFrame:
        """Entities left after each rule in turn: an entity is lost to a rule if any of its rows fell to it.

        One aggregation to a row per entity (position of its first losing rule), one over rule positions.
        """
        names = [name for name, _ in self.rules]
        place = F.coalesce(*(F.when(F.col(self.reason) == name, i) for i, name in enumerate(names)), F.lit(len(names)))
        first = self.marked.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(place).alias("place"))
        counts = first.groupBy("place").agg(F.count("*").alias("lost"))
        labels = F.array(*map(F.lit, [*names, "kept"]))
        steps = counts.sparkSession.range(len(names)).withColumnRenamed("id", "place").join(F.broadcast(counts), "place", "left")
        total = first.agg(F.count("*").alias("total"))
        running = F.sum(F.coalesce("lost", F.lit(0))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        out = steps.withColumn("running", running).crossJoin(F.broadcast(total))
        return out.select((F.col("place") + 1).cast("int").alias("step"), F.element_at(labels, (F.col("place") + 1).cast("int")).alias("rule"), F.coalesce("lost", F.lit(0)).alias("lost"), (F.col("total") - F.col("running")).alias("left"))

"""Arrays, nested rows, row generation and row repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, column: str, items: Column, keep_empty: bool = False) -> DataFrame:
    """One row per item of a cell; with ``keep_empty`` rows without items stay, with null."""
    return df.withColumn(column, (F.explode_outer if keep_empty else F.explode)(items))


def expand_product(df: DataFrame, found: Mapping[str, Column]) -> DataFrame:
    """Rows multiplied by the values found for several columns.

    Where any column has more than one distinct value, the row becomes the product of all columns' values;
    where each has at most one, the value replaces the cell; no value leaves the cell as it was.
    """
    out = df
    for name, values in found.items():
        distinct = F.array_distinct(F.coalesce(values, F.array().cast("array<string>")))
        out = out.withColumn(f"_{name}", F.when(F.size(distinct) == 0, F.array(F.col(name).cast("string"))).otherwise(distinct))
    for name in found:
        out = out.withColumn(name, F.explode(f"_{name}")).drop(f"_{name}")
    return out


def first_keyword(columns: Sequence[str], keywords: Sequence[str]) -> Column:
    """Per column the first keyword it contains; the distinct ones over all columns."""
    words = F.array(*map(F.lit, keywords))
    one = [F.get(F.filter(words, _inside(F.lower(F.coalesce(F.col(c), F.lit(""))))), F.lit(0)) for c in columns]
    return F.array_distinct(F.array_compact(F.array(*one)))


def _inside(text: Column):
    return lambda w: F.contains(text, w)


def recover_swaps(df: DataFrame, left: str, right: str, swapped: Column) -> DataFrame:
    """Rows whose two columns were swapped appear twice: as they were and corrected, told apart by ``variant``."""
    own = F.struct(F.lit("original").alias("variant"), F.col(left).alias("l"), F.col(right).alias("r"))
    fixed = F.struct(F.lit("swapped").alias("variant"), F.col(right).alias("l"), F.col(left).alias("r"))
    both = df.withColumn("_v", F.explode(F.when(F.coalesce(swapped, F.lit(False)), F.array(own, fixed)).otherwise(F.array(own))))
    return both.withColumn("variant", F.col("_v.variant")).withColumn(left, F.col("_v.l")).withColumn(right, F.col("_v.r")).drop("_v")


def assemble_lines(df: DataFrame, group: str, position: str, line: str, starts: Column, separator: str = " ") -> DataFrame:
    """Lines joined to records: a record goes from a line where ``starts`` to before the next; lines before the first start make record 0.

    The running count of starts is a window per group (one source file or document).
    """
    number = F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("record", number).groupBy(group, "record").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(line).alias("l")))).alias("_parts"))
    return parts.select(group, "record", F.array_join(F.transform("_parts", lambda p: p["l"]), separator).alias("text"), F.size("_parts").alias("lines"))


def repair_row(parts: Column, width: int, anchor: str, before: int, after: int, within: int = 8, overflow: int | None = None, joiner: str = ", ") -> Column:
    """A split row of any length as exactly ``width`` slots.

    The first part among ``within`` that matches ``anchor`` takes slot ``before``; the ``after`` last
    parts are the last slots; what lies between fills the middle: too few leave empty slots, too many are
    joined into the slot ``overflow`` (default: the last of the middle).  Null without an anchor.
    """
    n = F.size(parts)
    at = F.array_position(F.transform(F.slice(parts, F.lit(1), F.least(F.lit(within), F.greatest(n, F.lit(1)))), lambda p: p.rlike(anchor)), F.lit(True)).cast("int") - 1
    middle = width - before - 1 - after
    slot = middle - 1 if overflow is None else overflow - before - 1
    size = F.greatest(n - at - 1 - after, F.lit(0))
    blank = lambda count: F.array_repeat(F.lit(""), F.greatest(count, F.lit(0)).cast("int"))
    cutout = lambda start, length: F.slice(parts, start + 1, F.greatest(length, F.lit(0)))
    head = F.concat(blank(F.lit(before) - at), cutout(F.greatest(at - before, F.lit(0)), F.least(at, F.lit(before))))
    extra = size - middle
    joined = F.concat(cutout(at + 1, F.lit(slot)), F.array(F.array_join(cutout(at + 1 + slot, extra + 1), joiner)), cutout(at + 1 + slot + extra + 1, F.lit(middle - slot - 1)))
    filled = F.when(extra > 0, joined).otherwise(F.concat(cutout(at + 1, size), blank(F.lit(middle) - size)))
    last = F.least(F.lit(after), n - at - 1)
    tail = F.concat(cutout(n - last, last), blank(F.lit(after) - last))
    return F.when(at >= 0, F.concat(head, cutout(at, F.lit(1)), filled, tail))


def slots_to_rows(df: DataFrame, ids: Sequence[str], slots: Sequence[Mapping[str, str]]) -> DataFrame:
    """Numbered wide slots ([{field: column}, ...]) as rows with ``slot`` from 1; slots without any value go."""
    rows = F.array(*(F.struct(F.lit(i + 1).alias("slot"), *(F.col(c).cast("string").alias(f) for f, c in s.items())) for i, s in enumerate(slots)))
    filled = F.filter(rows, lambda r: F.coalesce(*(r[f] for f in slots[0])).isNotNull())
    return df.select(*ids, F.inline(filled))


def flatten_items(df: DataFrame, ids: Sequence[str], items: str, fields: Sequence[str]) -> DataFrame:
    """One row per nested item; a parent without items keeps one row with empty fields."""
    one = df.withColumn("_item", F.explode_outer(items))
    return one.select(*ids, *(F.col(f"_item.{f}").alias(f) for f in fields))


def merge_objects(df: DataFrame, key: Sequence[str], order: str, scalars: Sequence[str] = (), unions: Sequence[str] = (), na_tokens: Sequence[str] = ("", "unclear")) -> DataFrame:
    """Chunk results of one object as one row: the first informative scalar by ``order``, the union of lists."""
    informative = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin(*na_tokens)
    aggs = [F.min_by(F.col(c), F.when(informative(c), F.struct(F.col(order), F.col(c)))).alias(c) for c in scalars]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    return df.groupBy(*key).agg(*aggs, F.count("*").alias("chunks"))


def merge_entities(df: DataFrame, key: Sequence[str], rank_by: Column, unions: Sequence[str] = (), best: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Entities over chunks: union of lists, number of chunks, the best of graded values, and a rank in the parent (first key)."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions]
    for column, grades in (best or {}).items():
        place = F.array_position(F.array(*map(F.lit, grades)), F.col(column))
        aggs.append(F.element_at(F.array(*map(F.lit, grades)), F.min(F.when(place > 0, place)).cast("int")).alias(column))
    merged = df.groupBy(*key).agg(*aggs, F.count("*").alias("chunks"))
    return merged.withColumn("listed_rank", F.row_number().over(Window.partitionBy(key[0]).orderBy(rank_by, *key[1:])))


def reaggregate(df: DataFrame, key: Sequence[str], resolved: str, confidence: str, names: Sequence[str]) -> DataFrame:
    """Token results as cells again: sorted distinct names joined, status by how many resolved, mean confidence with two decimals."""
    n, good = F.count("*"), F.count_if(F.col(resolved))
    return df.groupBy(*key).agg(
        *(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(c) for c in names),
        F.when(good == n, "Resolved").when(good > 0, "Partially resolved").otherwise("Unresolved").alias("status"),
        F.format_string("%.2f", F.avg(confidence)).alias(confidence),
    )

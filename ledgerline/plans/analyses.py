"""Composite analyses: public functions that chain operators, each returning named result tables.

All take column names, so the same analysis runs on any star of records, entities and dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as T
from ledgerline.operators import agreement, extract, joins, nested, resolve, rules, sampling, stats, summaries

Results = dict[str, DataFrame]


def heal_rows(lines: DataFrame, group: str, position: str, line: str, starts: str, columns: Sequence[str], anchor: str, before: int, after: int, separator: str = r"\s*\|\s*", overflow: int | None = None) -> Results:
    """Broken export lines as a table of fixed columns, and a report of how many lines and rows were touched."""
    clean = lines.withColumn(line, T.sanitize_line(line))
    records = nested.assemble_lines(clean, group, position, line, F.col(line).rlike(starts)).where("record > 0")
    parts = F.split("text", separator)
    rows = records.withColumn("_n", F.size(parts)).withColumn("_row", nested.repair_row(parts, len(columns), anchor, before, after, overflow=overflow))
    table = rows.where("_row is not null").select(group, "record", *(F.trim(F.get("_row", F.lit(i))).alias(c) for i, c in enumerate(columns)))
    width = len(columns)
    report = rows.agg(F.count("*").alias("records"), F.count_if(F.col("lines") > 1).alias("joined"), F.count_if(F.col("_row").isNull()).alias("no_anchor"), F.count_if(F.col("_n") < width).alias("short"), F.count_if(F.col("_n") > width).alias("long"))
    return {"table": table, "report": report}


def resolve_cells(df: DataFrame, row: str, cell: str, group: str, accepted: DataFrame, synonyms: DataFrame, aliases: Mapping[str, str] | None = None, na_tokens: Sequence[str] = ()) -> Results:
    """Cells of several names resolved: a row per cell with names, ids, status and mean confidence, and the review queue."""
    tokens = nested.exploded(df.select(row, group, cell), "token", T.split_multi(cell, na_tokens=na_tokens))
    resolved = resolve.resolve_names(tokens, "token", group, accepted, synonyms, aliases)
    flat = resolved.withColumn("ok", F.col("resolved_id").isNotNull()).withColumn("ids", F.col("resolved_id").cast("string")).withColumnRenamed("method", "methods")
    cells = nested.reaggregate(flat, [row], "ok", "confidence", ["resolved_name", "ids", "methods"])
    queue = resolve.review_queue(resolved).groupBy("token", "method").agg(F.count("*").alias("n"))
    return {"cells": df.join(cells, row, "left"), "review": queue}


def standardise(df: DataFrame, mappings: Mapping[str, Mapping[str, str]], found: Mapping[str, Column] | None = None, swapped: tuple[str, str, Column] | None = None, na_phrases: Sequence[str] = ()) -> DataFrame:
    """Controlled vocabularies per column, swapped columns recovered, then rows expanded over several found values."""
    out = df
    for column, mapping in mappings.items():
        out = out.withColumn(column, T.standardize(column, mapping, na_phrases=na_phrases))
    if swapped:
        out = nested.recover_swaps(out, *swapped)
    return nested.expand_product(out, found) if found else out


def link_places(df: DataFrame, entity: str, cell: str, dimension: DataFrame, code: str, name: str, exclude: Sequence[str] = ()) -> Results:
    """Distinct (entity, code) links, counts per code with zeros, and the names that matched nothing."""
    places = nested.exploded(df.select(entity, cell), "place", T.clean_places(cell, exclude)).select(entity, "place").distinct()
    coded = joins.lookup(places, dimension.select(F.lower(name).alias("place"), code), ["place"])
    links = coded.where(F.col(code).isNotNull()).select(entity, code).distinct()
    counts = joins.lookup(dimension, links.groupBy(code).agg(F.countDistinct(entity).alias("study_count")), [code], {"study_count": 0})
    return {"links": links, "counts": counts, "unmatched": coded.where(F.col(code).isNull()).groupBy("place").agg(F.count("*").alias("n"))}


def enrich_places(dimension: DataFrame, code: str, series: Mapping[str, DataFrame], year: str, value: str) -> DataFrame:
    """A dimension with the latest value of each series ({column: rows of code, year, value}) and its year; null where a series has none."""
    out = dimension
    for column, rows in series.items():
        known = rows.where(F.col(value).isNotNull() & F.col(code).isNotNull())
        last = known.groupBy(code).agg(F.max_by(value, F.struct(year, value)).alias(column), F.max(year).alias(f"{column}_{year}"))
        out = out.join(joins.small(last), code, "left")
    return out


def quality_checks(df: DataFrame, key: str, required: Sequence[str], statuses: Sequence[str] = ()) -> Results:
    """Missing values, status counts, duplicate ids and a one-row profile."""
    profile = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("no_id"))
    out = {"missing": summaries.missingness(df, required), "duplicates": joins.duplicate_keys(df, [key]), "profile": profile}
    return out | ({"statuses": summaries.histogram(df, statuses)} if statuses else {})


def correlation(df: DataFrame, x: str, y: str) -> dict[str, float | int | None]:
    """Pearson and Spearman with their p values."""
    p, s = stats.pearson(df, x, y).first(), stats.spearman(df, x, y).first()
    value = lambda r, n: None if r is None or n < 3 else stats.correlation_p(r, n)
    return {"n": p["n"], "r": p["r"], "r_p": value(p["r"], p["n"]), "rho": s["rho"], "rho_p": value(s["rho"], s["n"])}


def coverage_levels(known: DataFrame, studied: DataFrame, levels: Sequence[str], group: str, most: int = 100) -> Results:
    """Coverage at each level by group and over all, and the most studied keys of the first level."""
    out: Results = {}
    for level in levels:
        out[f"{level}_by_{group}"] = summaries.coverage(known, studied, level, [group])
    total = None
    for level in levels:
        one = summaries.coverage(known, studied, level).withColumn("level", F.lit(level))
        total = one if total is None else total.unionByName(one)
    out["summary"] = total
    out["most_studied"] = summaries.top(summaries.counted(studied.where(F.col(levels[0]).isNotNull()), [levels[0]], share=None), most, "n", levels[0])
    return out


def understudied(known: DataFrame, studied: DataFrame, key: str, groups: Sequence[str]) -> Results:
    """Known keys nobody studied, and their number by group."""
    missing = joins.known_minus(known, studied, F.lower(T.squish(key)))
    return {"missing": missing, **{f"by_{g}": summaries.counted(missing, [g], share=None) for g in groups}}


def spatial_bias(df: DataFrame, entity: str, measure: str, group: str, classes: Sequence[tuple[float, str]], last: str, low: float, second_group: str | None = None) -> Results:
    """Percentile classes of all entities, the breakdown by group, its class heat map, and the breakdown by an alternative grouping."""
    bias = summaries.percentile_class(df, measure, classes, last)
    out = {"classes": bias, "breakdown": summaries.breakdown(df, group, measure, entity, low), "heatmap": summaries.counted(bias, [group, "bias_class"], within=[group])}
    if second_group:
        other = df.withColumn(group, F.coalesce(F.nullif(F.col(second_group), F.lit("")), F.col(group)))
        out["sensitivity"] = summaries.breakdown(other, group, measure, entity, low)
    return out


def association(df: DataFrame, a: str, b: str, k: int, entity: str | None = None) -> Results:
    """The k most frequent values of ``a`` (with ties) by all values of ``b``: cells, shares of each row, and the chi-square statistic."""
    most = summaries.top(summaries.counted(df.where(F.col(a).isNotNull()), [a], share=None), k, "n", a, ties=True)
    part = joins.among(df, most, [a])
    cells = summaries.counted(part, [a, b], entity, within=[a])
    rows = part.select(a, b, entity).distinct() if entity else part
    return {"cells": cells, "test": stats.chi_square(rows, a, b)}


def relationship_summaries(df: DataFrame, patterns: Sequence[tuple[str, str]], text: Column, entity: str, others: Sequence[str], default: str = "Other") -> Results:
    """A relationship class per row by ordered patterns; counts by row, by entity, and by entity within each other column."""
    classed = df.withColumn("relationship", rules.text_cascade(text, patterns, default))
    out = {"rows": summaries.counted(classed, ["relationship"]), "entities": summaries.counted(classed, ["relationship"], entity)}
    return out | {f"by_{o}": summaries.counted(classed, [o, "relationship"], entity, within=[o]) for o in others}


def priority_overlap(df: DataFrame, key: str, effort: str, priority: str, share: float = 0.5, group: str | None = None) -> Results:
    """Entities with little effort, high priority, or both; the overlap expected by chance; rank correlation; by group."""
    edges = df.agg(F.percentile(effort, 1 - share).alias("_e"), F.percentile(priority, share).alias("_p"))
    marked = df.crossJoin(F.broadcast(edges)).withColumn("low_effort", F.col(effort) <= F.col("_e")).withColumn("high_priority", F.col(priority) >= F.col("_p")).drop("_e", "_p")
    both = F.col("low_effort") & F.col("high_priority")
    counts = [F.count("*").alias("n"), F.count_if("low_effort").alias("low"), F.count_if("high_priority").alias("high"), F.count_if(both).alias("both")]
    expected = F.col("low") * F.col("high") / F.col("n")
    out = {"entities": marked, "summary": marked.agg(*counts).withColumn("expected", expected), "correlation": stats.spearman(df, effort, priority)}
    return out | ({"groups": marked.groupBy(group).agg(*counts).withColumn("expected", expected)} if group else {})


def robustness(df: DataFrame, key: str, effort: str, priority: str, area: str, region: str, shares: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> Results:
    """Threshold sweep, Kruskal-Wallis of effort over priority quartiles, regional counts, area-normalised ranks and a simple model."""
    tiles = summaries.cut_quantiles(df.where(F.col(priority).isNotNull()), priority, key)
    dense = df.withColumn("effort_density", S.density(effort, area)).withColumn("priority_density", S.density(priority, area))
    logs = df.withColumn("_x", S.log10p1(priority)).withColumn("_y", S.log10p1(effort))
    return {
        "sweep": stats.quantile_sweep(df, effort, priority, shares),
        "quartiles": tiles.groupBy("tile").agg(F.count("*").alias("n"), F.median(effort).alias("median"), F.avg(effort).alias("mean")),
        "quartile_test": stats.kruskal(tiles, effort, "tile"),
        "regions": stats.spearman(df, effort, priority, [region]),
        "density": stats.spearman(dense, "effort_density", "priority_density"),
        "model": stats.ols(logs, "_x", "_y"),
    }


def group_share(df: DataFrame, entity: str, condition: Column, by: Sequence[str]) -> Results:
    """Distinct entities that meet a condition: their share over all, and the ranked members by each column."""
    total = df.agg(F.countDistinct(entity).alias("all"), F.countDistinct(F.when(condition, F.col(entity))).alias("group")).withColumn("percent", S.percent("group", "all"))
    return {"share": total, **{f"by_{b}": summaries.counted(df.where(condition), [b], entity) for b in by}}


def by_group(df: DataFrame, group: str, values: Sequence[str], analysis: Callable[[DataFrame], Results]) -> Results:
    """An analysis for each value of a column and for all rows; same-named tables are united with ``group``."""
    runs = {v: analysis(df.where(F.col(group) == v)) for v in values} | {"all": analysis(df)}
    out: Results = {}
    for value, tables in runs.items():
        for name, table in tables.items():
            one = table.withColumn("of_group", F.lit(value))
            out[name] = one if name not in out else out[name].unionByName(one, allowMissingColumns=True)
    return out


def lineage_tables(df: DataFrame, item: str, lineage: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Items with their counts of distinct values and the modal lineage attached."""
    out = df.groupBy(item).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in counts))
    for column in lineage:
        out = out.join(summaries.modal(df, [item], column).drop("n"), item, "left")
    return out


def draw_sample(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: str, exclude: DataFrame | None = None, shared: int = 0) -> DataFrame:
    """A stratified sample in balanced order, without excluded ids; the first ``shared`` rows go to every rater."""
    pool = df.join(exclude.select(key).distinct(), key, "left_anti") if exclude is not None else df
    chosen = sampling.interleaved(sampling.stratified_sample(pool, n, strata, key, seed), strata, key, seed)
    return chosen.withColumn("block", F.when(F.col("place") <= shared, "shared").otherwise("single"))


def score(truth: DataFrame, found: DataFrame, ratings: DataFrame, key: Sequence[str], by: Sequence[str], fields: Sequence[str], item: Sequence[str], field: str, value: str, order: str) -> Results:
    """Precision and recall, field accuracy, consensus, agreement per field, and what was wrongly found or missed."""
    counts = agreement.agreement_counts(ratings, [field, *item], value)
    t, f = truth.select(*by, *key).distinct(), found.select(*by, *key).distinct()
    return {
        "prf": agreement.prf(truth, found, key, by),
        "fields": agreement.field_accuracy(truth, found, [*by, *key], fields),
        "consensus": agreement.consensus(ratings, [field, *item], value, order),
        "agreement": agreement.agreement(counts, item, value, [field]),
        "missed": t.join(f, [*by, *key], "left_anti"),
        "wrong": f.join(t, [*by, *key], "left_anti"),
    }


def multi_label_suite(df: DataFrame, entity: str, labels: Column, group: str, year: str, most: int = 50) -> Results:
    """Labels of a multi-valued cell: counts by entity, by group, pairs, richness per group, coverage curve, trend, grid."""
    rows = df.select(entity, group, year, F.explode(labels).alias("label")).distinct()
    counts = summaries.counted(rows, ["label"], entity)
    return {
        "counts": counts,
        "by_group": summaries.counted(rows, [group, "label"], entity, within=[group]),
        "pairs": joins.pairs_within(rows, entity, "label", most),
        "richness": rows.groupBy(group).agg(F.countDistinct("label").alias("labels"), F.countDistinct(entity).alias("entities")),
        "curve": summaries.coverage_curve(counts.drop("share"), "label"),
        "trend": rows.groupBy(year, "label").agg(F.countDistinct(entity).alias("n")),
        "grid": joins.complete(rows.groupBy(group, "label").agg(F.countDistinct(entity).alias("n")), [group, "label"], {"n": 0}),
    }


def staged_extraction(docs: DataFrame, key: str, text: str, heading: str, size: int, overlap: int, name_pattern: str, verify: str) -> Results:
    """Sections, chunks, entity mentions per chunk merged per document, and whether each has evidence near a keyword."""
    sections = extract.sections(docs, key, text, heading)
    whole = sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "body"))), lambda s: s["body"]), "\n").alias("kept"))
    pieces = extract.chunks(whole, key, "kept", size, overlap)
    mentions = pieces.select(key, "chunk_no", F.explode(F.array_distinct(F.regexp_extract_all("chunk", F.lit(name_pattern), F.lit(0)))).alias("name"))
    near = extract.evidence(whole, key, "kept", verify).select(key, F.lower("sentence").alias("_s"))
    entities = mentions.groupBy(key, F.lower("name").alias("name")).agg(F.count("*").alias("chunks"))
    backed = entities.join(near, key).where(F.contains("_s", "name")).select(key, "name").distinct().withColumn("_b", F.lit(True))
    ranked = entities.join(backed, [key, "name"], "left").withColumn("verified", F.coalesce("_b", F.lit(False))).drop("_b")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("verified"), F.desc("chunks"), "name"))
    return {"sections": sections, "chunks": pieces, "entities": ranked.withColumn("listed_rank", place)}


def plot_levels(df: DataFrame, group: str) -> DataFrame:
    """Known, studied and not studied in long form, with shares of the known: the frame of a stacked bar."""
    long = summaries.long(df.select(group, "known", F.col("studied").cast("long"), F.col("not_studied").cast("long")), [group, "known"], ["studied", "not_studied"], ("level", "n"))
    return long.withColumn("percent", S.percent("n", "known"))

"""Text regions: snippets around keywords, sections, chunks, claims, record parsing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T


#: Hits whose offsets are summed up at a time, so that the work stays linear in them.
CHUNK = 128
SPANS = "array<struct<start:int,end:int>>"


def hit_spans(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: offsets (from 0, end exclusive) of all matches, from the lengths of the gaps between them and of the matches."""
    value = F.coalesce(F.col(text), F.lit(""))
    hits, gaps = F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.split(value, pattern, -1)
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.greatest(F.size(hits), F.lit(1))), hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    rows = df.withColumn("_sizes", F.when(value.rlike(pattern), sized).otherwise(F.expr("cast(array() as array<struct<g:int,m:int>>)")))
    part = lambda c: F.slice(F.col("_sizes"), c * CHUNK + 1, F.lit(CHUNK))
    rows = rows.withColumn("_parts", F.when(F.size("_sizes") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / CHUNK).cast("int")), part)))
    none, last = F.expr(f"cast(array() as {SPANS})"), lambda out: F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0))
    inner = F.transform("_parts", lambda p: F.aggregate(p, none, lambda out, x: F.concat(out, F.array(F.struct((last(out) + x["g"]).alias("start"), (last(out) + x["g"] + x["m"]).alias("end"))))))
    moved = lambda out, p: F.transform(p, lambda x: F.struct((x["start"] + last(F.coalesce(F.try_element_at(out, F.lit(-1)), none))).alias("start"), (x["end"] + last(F.coalesce(F.try_element_at(out, F.lit(-1)), none))).alias("end")))
    every = F.flatten(F.aggregate(inner, F.expr(f"cast(array() as array<{SPANS}>)"), lambda out, p: F.concat(out, F.array(moved(out, p)))))
    return rows.withColumn(name, F.coalesce(every, none)).drop("_sizes", "_parts")


def snippets(df: DataFrame, key: str, text: str, pattern: str, window: int = 250, most: int = 5, budget: int = 8000) -> DataFrame:
    """(key, place, start, end, snippet): stretches around keyword hits, overlapping ones merged.

    At most ``most`` snippets per text and ``budget`` characters in all, in order; both are the feature
    (a context window for a reader or model).  Hits are merged inside the row, so no text is shuffled or copied
    for a hit.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = hit_spans(df.select(key, value.alias("_t")), "_t", pattern, "_h")
    size = F.length("_t")

    def step(acc: Column, h: Column) -> Column:
        """The stretch at hand grows, or is put away and a new one begins; those put away are ``most`` at most."""
        start, end = F.greatest(h["start"] - window, F.lit(0)), h["end"] + window
        joins = start <= acc["e"]
        put = F.when(joins | (acc["e"] < 0) | (F.size(acc["out"]) >= most), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))))
        return F.struct(put.alias("out"), F.when(joins, acc["s"]).otherwise(start).alias("s"), F.when(joins, F.greatest(acc["e"], end)).otherwise(end).alias("e"))

    begin = F.expr(f"named_struct('out', cast(array() as {SPANS}), 's', -1, 'e', -1)")
    merged = F.aggregate("_h", begin, step, lambda acc: F.when(acc["e"] < 0, acc["out"]).otherwise(F.slice(F.concat(acc["out"], F.array(F.struct(acc["s"].alias("start"), acc["e"].alias("end")))), F.lit(1), F.lit(most))))
    rows = rows.select(key, "_t", F.transform(merged, lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], size).alias("end"))).alias("_m"))

    def left(i: Column) -> Column:
        """The budget after the snippets before the ``i``-th."""
        return F.lit(budget) - F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0), lambda n, x: n + x["end"] - x["start"])

    cut = F.transform("_m", lambda x, i: F.struct((i + 1).alias("place"), x["start"].alias("start"), F.least(x["end"], x["start"] + left(i)).alias("end"), F.substr(F.col("_t"), x["start"] + 1, F.least(x["end"] - x["start"], F.greatest(left(i), F.lit(0)))).alias("snippet")))
    return rows.select(key, F.inline(F.filter(cut, lambda x: x["end"] > x["start"])))


def evidence(df: DataFrame, key: str, text: str, pattern: str, neighbours: int = 1) -> DataFrame:
    """(key, place, sentence): sentences with a hit and their neighbours, chosen inside the row."""
    parts = df.select(key, T.sentences(text).alias("_s"))
    parts = parts.select(key, "_s", F.transform("_s", lambda s: s.rlike(pattern)).alias("_hit"))

    def near(i: Column) -> Column:
        first = F.greatest(i + 1 - neighbours, F.lit(1))
        return F.exists(F.slice("_hit", first, i + 2 + neighbours - first), lambda h: h)

    kept = F.filter(F.transform("_s", lambda s, i: F.struct((i + 1).alias("place"), s.alias("sentence"), near(i).alias("near"))), lambda x: x["near"])
    return parts.select(key, F.inline(kept)).drop("near")


def chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, header: Column | None = None) -> DataFrame:
    """(key, chunk_no, chunk): fixed windows that overlap, the last one shorter, with an optional header before each."""
    value, step = F.coalesce(F.col(text), F.lit("")), size - overlap
    last = F.greatest(F.length(value) - overlap - 1, F.lit(0))
    rows = df.where(value != "").withColumn("_at", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    piece = F.substr(value, F.col("_at") + 1, F.lit(size))
    return rows.select(key, (F.col("_at") / step).cast("int").alias("chunk_no"), (F.concat(header, piece) if header is not None else piece).alias("chunk"))


def sections(df: DataFrame, key: str, text: str, heading: str, keep: str | None = None, drop: str | None = None, preamble: str = "preamble") -> DataFrame:
    """(key, section_no, heading, body): lines grouped under the heading lines before them.

    Lines of one text stay in one array and a section is a slice of it, so there is no shuffle and a line is
    looked at once.  ``keep``/``drop`` choose sections by heading.
    """
    rows = df.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(heading), i)), lambda i: i.isNotNull())
    # Where sections begin; the one before the first heading has no heading line.
    rows = rows.select(key, "_lines", F.concat(F.array(F.lit(-1)), heads, F.array(F.size("_lines"))).alias("_at"))

    def section(k: Column) -> Column:
        start, end = F.get("_at", k), F.get("_at", k + 1)
        body = F.trim(F.array_join(F.slice("_lines", start + 2, end - start - 1), "\n"))
        title = F.when(start < 0, F.lit(preamble)).otherwise(F.trim(F.get("_lines", start)))
        return F.struct(k.alias("section_no"), title.alias("heading"), body.alias("body"))

    out = rows.select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("_at") - 2), section))).where("body != ''")
    if keep:
        out = out.where(F.lower("heading").rlike(keep))
    return out.where(~F.lower("heading").rlike(drop)) if drop else out


def triage(df: DataFrame, key: str, text: str, wanted: str, budget: int) -> DataFrame:
    """Paragraphs with wanted words, in order, until a budget of characters is used up."""
    parts = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n")).alias("place", "paragraph")).where(F.lower("paragraph").rlike(wanted))
    used = F.sum(F.length("paragraph")).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("used", used).where(F.col("used") <= budget)


def table_class(text: Column) -> Column:
    """A page's kind by its share of digits and its table captions."""
    captions = F.regexp_count(text, F.lit(r"(?im)^\s*table\s+\d+"))
    digits = T.share_of(text)
    return F.when((captions >= 3) | (digits > 0.2), "table-heavy").when((captions >= 1) | (digits > 0.08), "some tables").otherwise("prose")


def records(df: DataFrame, text: str, split_at: str, fields: Mapping[str, str], number: str = "record_no") -> DataFrame:
    """Whole-text exports as rows: split before each record's start, then one pattern (group 1) per field."""
    parts = df.select(F.posexplode(F.split(F.col(text), split_at)).alias(number, "record")).where(F.trim("record") != "")
    value = lambda p: F.nullif(F.trim(F.regexp_extract("record", p, 1)), F.lit(""))
    return parts.select(number, *(value(p).alias(f) for f, p in fields.items()))


def claims(df: DataFrame, key: str, text: str, model, schema: str) -> DataFrame:
    """Rows of a pluggable model: ``model`` maps (key, text) pairs to dicts of ``schema``; batches travel by Arrow.

    The model is any function of an iterator, so a real one can load once per task; ``keyword_claims`` stands in
    for one without leaving the JVM.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(model(zip(batch[key], batch[text].fillna("")))), columns=names)

    return df.select(key, text).mapInPandas(run, schema)


#: All space characters of Unicode (category Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def keyword_claims(df: DataFrame, key: str, text: str, strong: Sequence[str], weak: Sequence[str], most: int = 3) -> DataFrame:
    """(key, is_claim, found, hedged, confidence, evidence): a deterministic stand-in for a language model, in the JVM.

    A claim is a sentence with a strong word; confidence falls with those of them that hold a weak word; the first
    ``most`` are the evidence.
    """
    # The dotted capital I becomes two characters in lower case otherwise.
    has = lambda s, words: F.coalesce(*(F.when(F.contains(F.lower(F.translate(s, "\u0130", "i")), F.lit(w)), True) for w in words), F.lit(False))
    parts = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(" ")), r"\. ")
    rows = df.select(F.col(key).alias("key"), F.transform(F.filter(parts, lambda s: has(s, strong)), lambda s: F.trim(s, F.lit(SPACES))).alias("f"))
    found, hedged = F.size("f"), F.size(F.filter("f", lambda s: has(s, weak)))
    confidence = F.when(found > 0, 1 - hedged / (2 * found)).otherwise(0.0)
    return rows.select("key", (found > 0).alias("is_claim"), found.alias("found"), hedged.alias("hedged"), confidence.alias("confidence"), F.slice("f", F.lit(1), F.lit(most)).alias("evidence"))

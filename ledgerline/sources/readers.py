"""Scans.  Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from csv import reader
from functools import reduce
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.functions.text import html_text


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def first_path(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists; FileNotFoundError without any."""
    for path in candidates:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Files a glob names, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(str(f.getPath()) for f in found or [])


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", schema: str | None = None, columns: Sequence[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """A delimited table as strings (or by schema), with cells of any length; only ``columns`` if given.

    Cells may hold quoted line breaks, so a file is read by one task; without ``line_breaks`` Spark splits large files.
    """
    scan = spark.read.option("header", True).option("sep", sep).option("multiLine", line_breaks).option("escape", '"').option("maxCharsPerColumn", -1)
    df = (scan.schema(schema) if schema else scan.option("inferSchema", False)).csv(path)
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def union_scan(spark: SparkSession, pattern: str, sep: str = ",", rename: Mapping[str, str] | None = None, source: str | None = None) -> DataFrame:
    """All files of a glob by column name, missing columns null; columns renamed on the way, files told apart by ``source``."""
    frames = []
    for path in files(spark, pattern):
        df = csv(spark, path, sep)
        df = df.select(*(F.col(f"`{c}`").alias((rename or {}).get(c, c)) for c in df.columns))
        frames.append(df.withColumn(source, F.lit(path.rsplit("/", 1)[-1])) if source else df)
    if not frames:
        raise FileNotFoundError(pattern)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shards(spark: SparkSession, pattern: str, key: Sequence[str], order: Sequence[Column | str], sep: str = ",") -> DataFrame:
    """Shard files united, one row per key: the first by ``order``."""
    from ledgerline.operators.dedup import keep_first

    return keep_first(union_scan(spark, pattern, sep, source="shard"), key, order)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, split, id): lines with their file, where their split of it begins, and an id that rises within the split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return rows.withColumn("id", F.monotonically_increasing_id())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines with their number in the file, from 0; large files are read in splits.

    A line's number is its place in its split after the lines of the splits before, which are counted first:
    a row for each split, of which a file has few.
    """
    from ledgerline.operators.joins import small

    rows = _placed(spark, path)
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return rows.join(small(starts), ["file", "split"]).select("file", (F.col("id") + F.col("shift")).cast("int").alias("line_no"), F.col("value").alias("line"))


def after_preamble(spark: SparkSession, path: str, skip: int, sep: str = ",") -> DataFrame:
    """Delimited files whose header follows a preamble of ``skip`` lines; rows are told apart from it by their place, not by what they say.

    The header is the first file's.  A row is a line: cells hold no line breaks.
    """
    numbered = lines(spark, path)
    head = numbered.where(F.col("line_no") == skip).orderBy("file").first()
    names = next(reader([head["line"]], delimiter=sep)) if head else []
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    body = numbered.where((F.col("line_no") > skip) & (F.trim("line") != ""))
    return body.select(F.from_csv("line", schema, {"sep": sep, "escape": '"'}).alias("r")).select("r.*")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


#: File names' endings of plain texts and of pages.
PLAIN, PAGES = ("txt", "text", "md", "markdown"), ("htm", "html")


def documents(spark: SparkSession, path: str, parsers: Mapping[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, kind, text, status): files by their ending - plain texts and markdown, pages as visible text, others by a parser.

    Plain texts may begin with a byte-order mark, and are Latin-1 where they are no UTF-8.  ``parsers`` maps an ending
    (such as ``pdf``) to a function of the bytes, which runs on the executors by Arrow batches; it may return an empty
    text (a scan without characters).  ``status``: ok, empty, failed (the parser raised), or unread (no parser).
    """
    found = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "content")
    mark = F.hex(F.substr("content", F.lit(1), F.lit(2)))
    utf = F.col("content").cast("string")
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).when(F.is_valid_utf8(utf), F.regexp_replace(utf, "^\ufeff", "")).otherwise(F.decode("content", "ISO-8859-1"))
    read = F.when(F.col("kind").isin(*PAGES), html_text(text)).otherwise(text)
    own = found.where(F.col("kind").isin(*PLAIN, *PAGES)).select("path", "kind", read.alias("text"), F.lit(None).cast("string").alias("status"))
    hooks = dict(parsers or {})
    rest = found.where(~F.col("kind").isin(*PLAIN, *PAGES))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kind, made, status = batch.column("kind")[i].as_py(), None, "unread"
                if kind in hooks:
                    try:
                        made, status = hooks[kind](batch.column("content")[i].as_py()), None
                    except Exception:  # one bad file is that file's status, not the end of the scan
                        status = "failed"
                yield pa.RecordBatch.from_pydict({"path": [batch.column("path")[i].as_py()], "kind": [kind], "text": pa.array([made], pa.string()), "status": pa.array([status], pa.string())})

    every = own.unionByName(rest.mapInArrow(parse, "path string, kind string, text string, status string"))
    ok = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("ok")
    return every.withColumn("status", F.coalesce("status", ok))


def binary_documents(spark: SparkSession, path: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """(path, text): files of any kind through ``to_text``, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_text(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def _cells(content: bytes, sheet: str | None) -> list[list[str | None]]:
    """Rows of a sheet of a workbook (a zip of XML parts), as text; numbers as they are written."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{main}t"))
    with ZipFile(BytesIO(content)) as book:
        part = lambda name: ElementTree.fromstring(book.read(name))
        shared = [text(x) for x in part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        sheets = {x.get("name"): targets[x.get(f"{rel}id")] for x in part("xl/workbook.xml").iter(f"{main}sheet")}
        name = sheet if sheet is not None else next(iter(sheets))
        if name not in sheets:
            raise KeyError(f"no sheet {name!r}; there are {', '.join(sheets)}")
        place = sheets[name].lstrip("/")
        out: list[list[str | None]] = []
        for row in part(place if place.startswith("xl/") else f"xl/{place}").iter(f"{main}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{main}c"):
                letters = "".join(c for c in cell.get("r", "") if c.isalpha())
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    at -= 1
                cells += [None] * (at - len(cells))
                kind, value = cell.get("t"), cell.find(f"{main}v")
                found = text(cell) if kind == "inlineStr" else None if value is None or value.text is None else shared[int(value.text)] if kind == "s" else value.text
                cells.append({"0": "false", "1": "true"}.get(found, found) if kind == "b" else found)
            out += [[]] * (int(row.get("r", len(out) + 1)) - 1 - len(out))
            out.append(cells)
        return out


def sheet(spark: SparkSession, path: str, name: str | None = None, skip: int = 0) -> DataFrame:
    """A sheet (the first by default) of the workbooks of a path as strings: the row after ``skip`` rows names the columns, blank rows go.

    Columns are the first workbook's; a sheet holds at most 2**20 rows, so one task reads a workbook.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _cells(batch.column("content")[i].as_py(), name)[skip:]
                made = [(n, r) for n, r in enumerate(rows) if any(c is not None and c.strip() for c in r)]
                columns = [pa.array([batch.column("path")[i].as_py()] * len(made), pa.string()), pa.array([n for n, _ in made], pa.int32()), pa.array([r for _, r in made], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "row_no", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row_no int, cells array<string>")
    head = rows.where("row_no = 0").orderBy("path").first()
    names = [n if n else f"column_{i + 1}" for i, n in enumerate(head["cells"])] if head else []
    return rows.where("row_no > 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def feature_attributes(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """The attributes of the features of GeoJSON files (such as areas with code, name, continent) as strings; shapes are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = whole.select(F.explode(F.try_variant_get("v", "$.features", "array<variant>")).alias("f"))
    return each.select(*(F.try_variant_get("f", f"$.properties['{name}']", "string").alias(name) for name in fields))


def config(spark: SparkSession, path: str) -> dict:
    """A JSON settings file, read once per session and path."""
    cache = spark.__dict__.setdefault("_ledgerline_config", {})
    if path not in cache:
        cache[path] = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    return cache[path]


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns, whatever its case; spaces, dots and underscores count alike."""
    plain = lambda c: c.lower().replace(" ", "_").replace(".", "_").strip("_")
    by = {plain(c): c for c in reversed(list(columns))}
    return next((by[plain(c)] for c in candidates if plain(c) in by), None)


def find_columns(columns: Sequence[str], keywords: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """{field: the first column whose name holds all of the field's keywords}."""
    return {f: c for f, words in keywords.items() if (c := next((c for c in columns if all(w in c.lower() for w in words)), None))}


def pages(fetch: Callable, schema: str, keys: DataFrame, key: str, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Paged sources: rows of ``schema`` for every key (a query, a year, a batch of ids), fetched on the executors, a key at a time.

    ``fetch(key, page)`` is given by the caller and returns (rows, the next page or None); the first page is None.  A
    page that raises is asked for again after ``wait`` seconds, then twice and four times that, ``retries`` times at
    most; then the task fails, and Spark runs it again.  ``incremental.with_cache`` asks for new keys only.
    """
    names = [c.split()[0] for c in schema.split(",")]
    kinds = keys.sparkSession.createDataFrame([], schema).schema

    def one(value: object, page: object) -> tuple:
        for nth in range(retries + 1):
            try:
                return fetch(value, page)
            except Exception:
                if nth == retries:
                    raise
                time.sleep(wait * 2**nth)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(kinds)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                page, more = None, True
                while more:
                    rows, page = one(value, page)
                    more = page is not None
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)

    return keys.select(key).mapInArrow(run, schema)


def memoised(spark: SparkSession, path: str, version: str, make) -> DataFrame:
    """A derived table kept as Parquet under its version; made anew when the version (settings, source stamp) changes."""
    place = f"{path.rstrip('/')}/version={version}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)

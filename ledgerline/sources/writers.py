"""Sinks: tables, kept and rejected rows, audits, reports, manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False, quote_all: bool = False) -> None:
    """Delimited text with a header; ``one_file`` only for results that are small by nature (reports)."""
    out = df.coalesce(1) if one_file else df
    flat = out.select(*(F.to_json(f"`{c}`").alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_kept_and_rejected(marked: DataFrame, reason: str, kept: str, rejected: str) -> None:
    """One marked table to two sinks: rows without a reason, and the others in a folder per reason.

    The marked rows are kept on the executors' disks in between, so the marking runs once; what a lost
    executor held is made again.
    """
    rows = marked.persist(StorageLevel.DISK_ONLY)
    try:
        rows.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(kept)
        rows.where(F.col(reason).isNotNull()).write.mode("overwrite").partitionBy(reason).parquet(rejected)
    finally:
        rows.unpersist()


def write_audit(removed: DataFrame, path: str, by: str = "removed_by") -> None:
    """What each stage removed, in a folder per stage."""
    removed.write.mode("overwrite").partitionBy(by).parquet(path)


def write_twin(df: DataFrame, path: str, positive: str | None = None) -> None:
    """Lines of JSON, a delimited copy, and the rows where ``positive`` holds."""
    df.write.mode("overwrite").json(f"{path}/jsonl")
    write_csv(df, f"{path}/csv")
    if positive:
        write_csv(df.where(positive), f"{path}/positive")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "gzip").json(path)


def _text(df: DataFrame, path: str, text: str) -> None:
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def qa_report(profile: Mapping[str, object], missing: Mapping[str, float], duplicates: int, warn_at: float = 50.0) -> dict:
    """PASS, PASS_WITH_WARNINGS or FAIL from an aggregated profile: duplicates and unbalanced counts fail, missing columns warn."""
    failures = [f"{duplicates} duplicate ids"] * bool(duplicates)
    if {"rows_in", "kept", "rejected"} <= set(profile) and profile["rows_in"] != profile["kept"] + profile["rejected"]:
        failures.append("kept and rejected rows do not add up")
    warnings = [f"{c}: {p:.1f}% missing" for c, p in sorted(missing.items()) if p >= warn_at]
    return {"status": "FAIL" if failures else "PASS_WITH_WARNINGS" if warnings else "PASS", "failures": failures, "warnings": warnings, **profile}


def markdown(title: str, rows: list[Mapping[str, object]]) -> str:
    """A small table as markdown."""
    if not rows:
        return f"# {title}\n\nno rows\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"


def write_report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A result that is small by nature as a markdown file; beyond ``most`` rows it says how many there are besides."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    more = f"\n{df.count() - most} more rows are not shown.\n" if len(rows) > most else ""
    _text(df, path, markdown(title, rows[:most]) + more)


def manifest(df: DataFrame, path: str, settings: Mapping[str, object]) -> dict:
    """What was run: settings, their hash, schema and row count, written beside the result."""
    said = {"settings": dict(settings), "hash": hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest(), "schema": df.schema.simpleString(), "rows": df.count()}
    _text(df, path, json.dumps(said, sort_keys=True, default=str))
    return said

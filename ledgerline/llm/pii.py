"""Personal data in texts, by DataFrame operations alone.

Regular expressions propose spans, checksum validators (Luhn for cards, mod-97 for account numbers,
ranges for addresses and social security numbers) confirm them, and words near a span adjust its
score.  Positions come from the gaps that ``split`` leaves between the matches of the same pattern.

The four base kinds (email, ip, card, phone) are always reported once their validator agrees; the
context only moves their score.  The added kinds (iban, ssn) are reported from ``threshold`` on.

Work is linear in the length of a text and, but for a small factor, in its matches: sums run in chunks of
matches, and what is near a span comes from pieces of the text.

Defined results: a null text counts as empty; an empty text has no span; spans are offsets in code
points, end exclusive; spans of different kinds may overlap; repeated rows and rows without an id each get
their own; an empty table gives an empty result; columns besides id and text are ignored, or pass through
``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table

#: Kinds in the order of ties at one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# ``\G`` and the look-behinds let a match begin only where the plain pattern's leftmost match can
# begin (a run's first character, or where the match before ended), so long runs cost linear time;
# possessive quantifiers never give characters back.  Matches are those of the plain patterns.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of 12 to 19 digits: matches of the plain pattern are whole runs
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character without which a text has no match; saves the scan.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank|konto",
    "ssn": r"ssn|social|security",
}
#: Score of a confirmed span without context words; with them BONUS is added.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
BONUS = 0.25
#: Code points before and after a span that are searched for context words.
NEAR = 40
#: Matches that are summed up at a time; code points of a piece of text (and NEAR more at both ends).
CHUNK, PIECE = 128, 4096


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the string of digits passes the Luhn check."""
    reverse = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))

    def add(total: Column, item: Column, i: Column) -> Column:
        twice = item.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    each = F.transform(reverse, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(each, F.lit(0), lambda a, x: add(a, x["d"], x["i"])) % 10 == 0


def mod97(value: Column) -> Column:
    """True if the account number, its first four characters last and letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.regexp_extract_all(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), F.lit("[A-Z0-9]"), F.lit(0))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    if kind == "ssn":
        return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _chunked(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items, so that sums and joins over it stay linear."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK))))


def _ends(chunks: Column) -> Column:
    """Running sums of the fields ``gap`` and ``own`` over chunks of structs, as one array: in chunks first, then over them."""
    none = F.expr("cast(array() as array<int>)")
    last = lambda out: F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0))
    inner = F.transform(chunks, lambda chunk: F.aggregate(chunk, none, lambda out, x: F.concat(out, F.array(last(out) + x["gap"] + x["own"]))))
    return F.flatten(F.aggregate(inner, F.expr("cast(array() as array<array<int>>)"), lambda out, part: F.concat(out, F.array(F.transform(part, lambda e: e + last(F.coalesce(F.try_element_at(out, F.lit(-1)), none)))))))


def _found(docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(_row: the columns of ``docs`` as one struct, _text, _findings); the names of ``docs`` meet no helper's."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    text, none = F.col("_text"), F.expr("cast(array() as array<string>)")
    may = {k: F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True) for k in PATTERNS}
    rows = rows.select("*", *(F.when(may[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, p in PATTERNS.items()))
    # Gaps between the matches, with the matches' lengths; then the text in overlapping pieces, for what is near a span.
    sized = lambda k: F.zip_with(F.slice(F.split(text, PATTERNS[k], -1), F.lit(1), F.size(f"_{k}")), F.col(f"_{k}"), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    rows = rows.select("*", *(F.when(F.size(f"_{k}") > 0, sized(k)).alias(f"_{k}_sizes") for k in PATTERNS))
    any_found = F.lit(False)
    for k in PATTERNS:
        any_found = any_found | (F.size(f"_{k}") > 0)
    piece = lambda i: F.substr(text, F.greatest(i * PIECE - NEAR, F.lit(0)) + 1, F.lit(PIECE + 2 * NEAR))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), piece)
    rows = rows.select("*", *(_chunked(F.col(f"_{k}_sizes")).alias(f"_{k}_chunks") for k in PATTERNS), F.when(any_found, pieces).alias("_pieces"))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)")

    def spans(kind: str) -> Column:
        def near(x: Column) -> Column:
            """NEAR code points before a span and after it; its end may lie in a later piece."""
            at = lambda i: F.greatest(i * PIECE - NEAR, F.lit(0))
            first, last = F.floor(x["start"] / PIECE).cast("int"), F.floor(x["end"] / PIECE).cast("int")
            before = F.greatest(x["start"] - NEAR, F.lit(0))
            return F.lower(F.concat(F.substr(F.get("_pieces", first), before - at(first) + 1, x["start"] - before), F.lit(" "), F.substr(F.get("_pieces", last), x["end"] - at(last) + 1, F.lit(NEAR))))

        def judged(x: Column) -> Column:
            score = F.lit(PRIOR[kind]) + F.when(near(x).rlike(CONTEXT[kind]), BONUS).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        located = F.zip_with(F.col(f"_{kind}"), _ends(F.col(f"_{kind}_chunks")), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        good = F.transform(F.filter(located, lambda x: confirmed(kind, x["value"])), judged)
        if kind not in BASE:
            good = F.filter(good, lambda s: s["score"] >= threshold)
        return F.when(F.size(f"_{kind}") > 0, good).otherwise(empty)

    return rows.select("_row", "_text", F.array_sort(F.concat(*map(spans, KINDS))).alias("_findings"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``findings``: array<struct<start, rank, end, kind, score>>, sorted; rank orders the kinds.

    Returns id, text (null: empty), the columns in ``keep`` (but for one named ``findings``), and findings.
    """
    found = _found(docs, text_col, threshold)
    return found.select(F.col("_row")[id_col].alias(id_col), F.col("_text").alias(text_col), *(F.col("_row")[c].alias(c) for c in keep if c != "findings"), F.col("_findings").alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span found replaced by its kind in brackets; where spans overlap, the first's kind stands.

    A null text becomes an empty one.  All other columns pass unchanged, whatever their names.
    """
    found = _found(docs, text_col, threshold)
    found = found.select("*", _chunked(F.col("_findings")).alias("_chunks"))
    text = F.col("_text")

    def one(acc: Column, s: Column) -> Column:
        """A span after ``at``: the text before it, and its kind.  ``region`` is the text of the chunk, from ``base`` on."""
        fresh = F.concat(acc["out"], F.array(F.substr(acc["region"], acc["at"] - acc["base"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        out = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"), acc["base"].alias("base"), acc["region"].alias("region"))

    def many(acc: Column, chunk: Column) -> Column:
        reach = F.array_max(F.transform(chunk, lambda s: s["end"]))
        region = F.substr(text, acc["at"] + 1, F.greatest(reach - acc["at"], F.lit(0)))
        start = F.struct(acc["at"].alias("at"), F.expr("cast(array() as array<string>)").alias("out"), acc["at"].alias("base"), region.alias("region"))
        # The end of what is done and the text so far leave the chunk as one struct.
        return F.aggregate(chunk, start, one, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array_join(x["out"], "")).alias("out")))

    clean = F.aggregate("_chunks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), many, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    redacted = F.when(F.size("_findings") > 0, clean).otherwise(text)
    return found.select(*((redacted if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents")).select("doc_id", "findings")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN {digits}[i]::INT ELSE CASE WHEN {digits}[i]::INT > 4 THEN 2 * {digits}[i]::INT - 9 ELSE 2 * {digits}[i]::INT END END)) % 10 = 0"
    good = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: p::HUGEINT <= 255))",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    parts = []
    for rank, kind in enumerate(BASE):
        parts.append(
            f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e FROM (
  SELECT rid, m[i] AS v, list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s FROM (
    SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{plain[kind]}') AS m, string_split_regex(t, '{plain[kind]}') AS g FROM docs) WHERE len(m) > 0)) WHERE {good[kind]}"""
        )
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
joined AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM found GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (rid)"""


#: The base kinds; on the given tables the added kinds find nothing, which the driver's comparison shows.
ORACLE = _oracle()

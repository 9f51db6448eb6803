"""Text functions.  All but ``quote_support`` are built-in expressions: they stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squish(x: Text) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def dedup_key(x: Text) -> Column:
    """Lower case, white space squeezed, punctuation dropped, trimmed - in this order, so spaces may double."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"\s+", " "), r"\p{Punct}", ""))


def normalize_doi(x: Text) -> Column:
    """Lower-case identifier without resolver, prefix and trailing marks; null where nothing is left or it says na/null."""
    bare = F.regexp_replace(F.lower(F.trim(_c(x))), r"^https?://(?:dx\.)?doi\.org/", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^doi:\s*", ""), r"[.,;]+$", ""))
    return F.when(~bare.isin("", "na", "null"), bare)


#: The Hangul syllables, which Unicode takes apart by arithmetic.
HANGUL = (0xAC00, 0xD7A3)


@cache
def _unicode(form: str, marks: bool) -> tuple[str, str, dict[str, str]]:
    """By a normal form of Unicode: characters that become one other, what they become, and those that become several.

    Without ``marks`` combining characters go.  The tables are Python's own; Hangul syllables are left out.
    """
    one, to, gone, many = [], [], [], {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if HANGUL[0] <= ord(c) <= HANGUL[1] or 0xD800 <= ord(c) <= 0xDFFF:
            continue
        plain = unicodedata.normalize(form, c)
        if not marks:
            plain = "".join(x for x in plain if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) > 1:
            many[c] = plain
        else:
            (one if plain else gone).append(c)
            to += plain
    return "".join(one + gone), "".join(to), many


def _swapped(x: Column, found: Column, values: dict[str, str]) -> Column:
    """Every string of the array ``found`` replaced in the text by its value."""
    table = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in values.items())), F.lit("\u0001"), F.lit("\u0002"))
    return F.aggregate(F.array_distinct(found), x, lambda text, c: F.replace(text, c, F.coalesce(F.try_element_at(table, c), c)))


def _normal(x: Column, form: str, marks: bool = True) -> Column:
    """The compatibility form of each character; texts in ASCII, which are most, pass as they are."""
    one, to, many = _unicode(form, marks)
    plain = F.translate(x, one, to)
    plain = _swapped(plain, F.regexp_extract_all(plain, F.lit("[" + "".join(many) + "]"), F.lit(0)), many)
    return F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x)


def _jamo(x: Column) -> Column:
    """Hangul syllables as their two or three letters."""

    def letters(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - HANGUL[0]
        sign = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")
        last = F.when(code % 28 > 0, sign((code % 28 + 0x11A7).cast("long"))).otherwise("")
        return F.concat(sign((F.floor(code / 588) + 0x1100).cast("long")), sign((F.floor(code % 588 / 28) + 0x1161).cast("long")), last)

    found = F.array_distinct(F.regexp_extract_all(x, F.lit("[\uac00-\ud7a3]"), F.lit(0)))
    return F.when(x.rlike("[\uac00-\ud7a3]"), F.aggregate(found, x, lambda text, c: F.replace(text, c, letters(c)))).otherwise(x)


def fold_accents(x: Text) -> Column:
    """The text in compatibility decomposition (NFKD), combining marks dropped."""
    return _jamo(_normal(_c(x), "NFKD", marks=False))


def compatible(x: Text) -> Column:
    """The text in compatibility composition (NFKC): each character's form, then letters joined with up to two marks after them."""
    plain = _normal(_c(x), "NFKC")
    pairs = _pairs()
    for _ in range(2):
        plain = F.when(plain.rlike(r"\p{M}"), _swapped(plain, F.regexp_extract_all(plain, F.lit(r"\P{M}\p{M}"), F.lit(0)), pairs)).otherwise(plain)
    return plain


@cache
def _pairs() -> dict[str, str]:
    """Letter and mark -> the one character they compose to."""
    out = {}
    for c in map(chr, range(128, 0x3100)):
        apart = unicodedata.normalize("NFD", c)
        two = unicodedata.normalize("NFC", apart[:-1]) + apart[-1]
        if len(two) == 2 and unicodedata.normalize("NFC", two) == c:
            out[two] = c
    return out


def normalize_key(x: Text, na_tokens: Sequence[str] = ()) -> Column:
    """Squished lower case without accents; missing-value words become an empty string."""
    key = fold_accents(F.lower(squish(F.coalesce(_c(x), F.lit("")))))
    return F.when(key.isin(*na_tokens), "").otherwise(key) if na_tokens else key


def canonical_binomial(x: Text) -> Column:
    """Genus and epithet in lower case; ``x. epithet`` where the genus is an initial, the genus alone for ``sp.``.

    Brackets go, a hybrid sign between the two words is skipped, authorship after them is ignored.
    """
    bare = F.regexp_replace(_c(x), r"\([^)]*\)|\[[^\]]*\]", " ")
    words = F.filter(F.split(F.lower(squish(F.regexp_replace(bare, r"[^\p{L}. -]", " "))), " "), lambda w: ~w.isin("x", "×", ""))
    first, second = F.get(words, F.lit(0)), F.regexp_replace(F.get(words, F.lit(1)), r"\.$", "")
    return (
        F.when(F.size(words) == 0, "")
        .when(second.isNull() | second.isin("sp", "spp", "species"), F.regexp_replace(first, r"\.$", ""))
        .when(first.rlike(r"^\p{L}\.?$"), F.concat(F.substr(first, F.lit(1), F.lit(1)), F.lit(". "), second))
        .otherwise(F.concat_ws(" ", F.regexp_replace(first, r"\.$", ""), second))
    )


def split_multi(x: Text, pattern: str = r"\s*(?:;|\||/|,|\band\b)\s*", na_tokens: Sequence[str] = ()) -> Column:
    """A cell of several values as an array, trimmed, without blanks and missing-value words."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), f"(?i){pattern}"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*na_tokens) if na_tokens else p != "")


def clean_name(x: Text, na_words: Sequence[str] = ("none", "null", "na", "n/a", "unknown"), most_words: int = 6, longest: int = 60) -> Column:
    """A free-text name without tags, brackets, quotes and leading labels; null where it is a missing word or no name by its size."""
    bare = F.regexp_replace(_c(x), r"<[^>]*>|\([^)]*\)|[\[\]{}\"]", " ")
    bare = F.lower(squish(F.regexp_replace(bare, r"^\s*\w+\s*:\s*", "")))
    bad = (bare == "") | bare.isin(*na_words) | (F.size(F.split(bare, " ")) > most_words) | (F.length(bare) > longest)
    return F.when(~bad, bare)


def squish_all(df, lower: bool = True):
    """Every string column squished (and in lower case)."""
    return df.select(*((F.lower(squish(c)) if lower else squish(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def sanitize_line(x: Text) -> Column:
    """Backslashes dropped; with an odd number of double quotes all of them go."""
    line = F.replace(_c(x), F.lit("\\"), F.lit(""))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.replace(line, F.lit('"'), F.lit(""))).otherwise(line)


def strip_parentheses(x: Text) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\(.*?\)", ""))


def _literal(key: str) -> str:
    return r"\Q" + key.replace(r"\E", r"\E\\E\Q") + r"\E"


def standardize(x: Text, mapping: Mapping[str, str], mode: str = "substring", na_phrases: Sequence[str] = (), shortest: int = 3) -> Column:
    """A controlled value for free text: missing phrases first, then an exact key, then the longest key contained.

    ``mode`` 'word' asks for whole words, 'substring' does not.  Values shorter than ``shortest`` that no
    key matches become null, others stay as they are (lower case).
    """
    value = F.lower(strip_parentheses(x))
    chain = F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
    for phrase in na_phrases:
        chain = chain.when(F.contains(value, F.lit(phrase)), F.lit(None).cast("string"))
    for key, target in mapping.items():
        chain = chain.when(value == key, target)
    for key in sorted(mapping, key=lambda k: -len(k)):
        hit = value.rlike(rf"(?<!\w){_literal(key)}(?!\w)") if mode == "word" else F.contains(value, F.lit(key))
        chain = chain.when(hit, mapping[key])
    return chain.when(F.length(value) >= shortest, value)


def clean_places(x: Text, exclude: Sequence[str] = (), suffixes: str = "province|region|state|county|district|prefecture", directions: str = "northern|southern|eastern|western|central|north|south|east|west") -> Column:
    """Place names of a cell: separated, without brackets, administrative suffixes, directions, numbers and excluded words."""
    bare = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[\[\]()\"'.]", "")
    parts = F.split(bare, r"\s*(?:[,;]|\band\b)\s*")
    named = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), rf"\s+(?:{suffixes})$", ""), rf"^(?:{directions})\s+", "")))
    return F.filter(named, lambda p: (F.length(p) > 2) & ~p.rlike(r"^\d+$") & (~p.isin(*exclude) if exclude else F.lit(True)))


def first_item(x: Text, separator: str = ";") -> Column:
    """The first element of a separated list."""
    return F.regexp_extract(_c(x), f"^[^{separator}]+", 0)


def plausible_year(x: Text) -> Column:
    """The first year from 1500 to 2099 in the text, as an integer."""
    return F.regexp_extract(_c(x), r"\b(1[5-9]\d\d|20\d\d)\b", 1).try_cast("int")


def strip_suffix(x: Text, suffix: Text, tail: str = r"\s+\(?[A-Z][^ ]*.*$") -> Column:
    """The text without a known suffix (such as an authorship), else without what matches ``tail``."""
    value, end = _c(x), _c(suffix)
    return F.trim(F.when(end.isNotNull() & (end != "") & value.endswith(end), F.substr(value, F.lit(1), F.length(value) - F.length(end))).otherwise(F.regexp_replace(value, tail, "")))


def slug(x: Text, fill: str = "_") -> Column:
    """A name for a file: other characters than letters, digits, dot and dash replaced, no fill at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9.-]+", fill), f"^{fill}+|{fill}+$", "")


def letters_key(x: Text) -> Column:
    """Lower-case letters and spaces only: the key of loose name lookups."""
    return F.lower(F.regexp_replace(_c(x), "[^A-Za-z ]", ""))


def alnum_key(x: Text) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


#: Codes of strains and collections, open-nomenclature words, and letters of names, as name keys must read them.
STRAIN_CODE = r"\b(?:[A-Z]{2,6}[- ]?\d[\w.\-]*|\d+[A-Z]+[\w\-]*|CBS\s*\d+[\d.]*|ATCC\s*\d+)\b"
OPEN_NAMES = r"(?i)\b(?:cf|aff|sensu lato|s\.l|nom\.?|nov|comb)\b\.?"
NAME_LETTERS = r"[A-Za-z\u00c0-\u024f\-]+"


def name_key(x: Text) -> Column:
    """The first two words of a name in lower case, without brackets, open-nomenclature words and strain codes; ``spp`` counts as ``sp``."""
    bare = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\(.*?\)", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, OPEN_NAMES, " "), STRAIN_CODE, " ")
    words = F.slice(F.transform(F.regexp_extract_all(bare, F.lit(NAME_LETTERS), F.lit(0)), F.lower), F.lit(1), F.lit(2))
    return F.regexp_replace(F.array_join(words, " "), " spp$", " sp")


def plain_key(x: Text) -> Column:
    """Lower-case letters, digits and spaces only; blank and null as an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9 ]", ""))


def genus_key(x: Text) -> Column:
    """The first word of the plain key."""
    return F.substring_index(plain_key(x), " ", 1)


def species_key(x: Text, drop: Sequence[str] = ("sp", "spp", "cf", "aff")) -> Column:
    """The first two words of the plain key but for open-nomenclature marks."""
    return F.array_join(F.slice(F.filter(F.split(plain_key(x), " "), lambda w: ~w.isin(*drop)), F.lit(1), F.lit(2)), " ")


def host_key(x: Text) -> Column:
    """Lower-case letters and spaces only; null as an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z ]", ""))


def quote_text(x: Text) -> Column:
    """Text for quote checks: compatibility form, curly quotes and dashes plain, hyphenation undone, markdown and table signs as spaces, lower case, squished."""
    plain = F.translate(compatible(F.coalesce(_c(x), F.lit(""))), "“”‘’–—−\u00a0\u00ad", "\"\"''--- ")
    plain = F.regexp_replace(F.lower(plain), r"-\s*\n\s*", "")
    return squish(F.regexp_replace(plain, r"[*_`#>|]", " "))


def shared_length(masks: Mapping[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence, by one addition of whole words per character of ``window``."""
    full = (1 << size) - 1
    row = full
    for c in window:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _grams(text: str) -> np.ndarray:
    """A number for each three characters in a row."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _likely(short: str, long: str, at_least: float) -> np.ndarray:
    """Starts of the stretches of ``long`` that may be as like ``short`` as wanted, those that share most first; no other stretch is.

    Where ``lost`` characters of ``short`` and ``extra`` ones of the stretch have no partner, at most 3 * lost + 2 * extra of
    the runs of three in ``short`` are broken; the others stand in the stretch.
    """
    n, size = len(short), len(long)
    starts = np.arange(1 - n, size)
    low, high = np.maximum(starts, 0), np.minimum(starts + n, size)
    common = np.ceil((at_least * (n + high - low) - 1e-9) / 2 - 1e-9)
    need = n - 2 - 3 * (n - common) - 2 * (high - low - common)
    runs = np.concatenate([[0], np.cumsum(np.isin(_grams(long), np.unique(_grams(short))))])
    have = runs[np.maximum(high - 2, low).clip(max=len(runs) - 1)] - runs[low.clip(max=len(runs) - 1)]
    some = np.flatnonzero((common <= high - low) & (have >= need))
    return starts[some[np.argsort(-have[some], kind="stable")]]


def aligned(quote: str, text: str, at_least: float) -> bool:
    """Whether some stretch of the longer text is like the shorter one: 2 * common / (both lengths) of ``at_least`` or more.

    Stretches are as long as the shorter text, or what is left of that at either end.  All are counted by the runs
    of three characters that they share with it; those that share enough are compared.
    """
    short, long = (quote, text) if len(quote) <= len(text) else (text, quote)
    n = len(short)
    if not n:
        return False
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    seen = set()
    for start in _likely(short, long, at_least).tolist():
        window = long[max(start, 0) : start + n]
        if window not in seen:
            seen.add(window)
            if 2 * shared_length(masks, n, window) >= at_least * (n + len(window)) - 1e-9:
                return True
    return False


_PLAIN = str.maketrans("“”‘’–—−\u00a0", "\"\"''--- ", "\u00ad")
_HYPHENS, _SIGNS, _SPACES = re.compile(r"-[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*"), re.compile(r"[*_`#>|]"), re.compile(r"[ \t\n\x0b\f\r]+")


def _quote_text(x: str | None) -> str:
    """``quote_text`` of one string."""
    x = x or ""
    if not x.isascii():
        x = unicodedata.normalize("NFKC", x).translate(_PLAIN)
    return _SPACES.sub(" ", _SIGNS.sub(" ", _HYPHENS.sub("", x.lower()))).strip(" ")


def quote_support(quote: Text, text: Text, at_least: float = 0.92, shortest: int = 25) -> Column:
    """'exact', 'fuzzy', 'none' or 'empty'.

    Fuzzy is the best alignment of the quote anywhere in the text (see ``aligned``); quotes under
    ``shortest`` characters must be exact.  Both sides are normalised beside the alignment, by Arrow batches: built-in
    functions take many times as long for the compatibility form of texts with accents.
    """

    def support(quote: str | None, text: str | None) -> str:
        q = _quote_text(quote)
        if not q:
            return "empty"
        t = _quote_text(text)
        if q in t:
            return "exact"
        return "fuzzy" if len(q) >= shortest and aligned(q, t, at_least) else "none"

    @F.pandas_udf("string")
    def supports(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for quotes, texts in batches:
            yield pd.Series([support(a, b) for a, b in zip(quotes, texts)], dtype=object)

    return supports(_c(quote).cast("string"), _c(text).cast("string"))


#: How coordinates are written - degrees, and minutes and seconds if given, with a hemisphere; or two decimals.
ANGLE = r"{digits}(?:[.,]\d+)?\s*[°º]\s*(?:\d{{1,2}}(?:[.,]\d+)?\s*['′]\s*)?(?:\d{{1,2}}(?:[.,]\d+)?\s*(?:\"|″|'')\s*)?{ends}"
LATITUDE, LONGITUDE = ANGLE.format(digits=r"\d{1,2}", ends="[NS]"), ANGLE.format(digits=r"\d{1,3}", ends="[EW]")
DECIMALS = r"(?<![\d.])(-?\d{1,2}\.\d{3,})\s*[,;/ ]\s*(-?\d{1,3}\.\d{3,})(?![\d.])"


def coordinates(x: Text) -> Column:
    """array<struct<text, lat, lon>>: pairs of degrees with hemispheres (five decimals), then decimal pairs; only those within range."""
    pair = rf"({LATITUDE})[\s,;/]+({LONGITUDE})"

    def angle(m: Column, group: int) -> Column:
        """Degrees, minutes and seconds in the order written; south and west are negative."""
        part = F.regexp_extract(m, pair, group)
        numbers = F.transform(F.regexp_extract_all(part, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))
        size = lambda i: F.coalesce(F.get(numbers, F.lit(i)), F.lit(0.0)) / 60**i
        value = size(0) + size(1) + size(2)
        return F.round(F.when(part.rlike("[SW]$"), -value).otherwise(value), 5)

    text = F.coalesce(_c(x), F.lit(""))
    decimal = lambda m, g: F.regexp_extract(m, DECIMALS, g).cast("double")
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(pair), F.lit(0)), lambda m: F.struct(m.alias("text"), angle(m, 1).alias("lat"), angle(m, 2).alias("lon"))),
        F.transform(F.regexp_extract_all(text, F.lit(DECIMALS), F.lit(0)), lambda m: F.struct(m.alias("text"), decimal(m, 1).alias("lat"), decimal(m, 2).alias("lon"))),
    )
    return F.filter(found, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))


def tokens(x: Text) -> Column:
    """Lower-case words of letters."""
    return F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")


def guess_language(x: Text, stopwords: Mapping[str, Sequence[str]], share: float = 0.12, shortest: int = 30, head: int = 6000) -> Column:
    """The language whose stop words make up the largest share of the first words, over ``share``; else 'other'; 'unclear' for short texts."""
    words = tokens(F.substr(_c(x), F.lit(1), F.lit(head)))
    n = F.size(words)
    shares = [F.struct((F.size(_among(words, stop)) / n).alias("share"), F.lit(name).alias("name")) for name, stop in sorted(stopwords.items())]
    best = F.array_max(F.array(*shares))
    return F.when(n < shortest, "unclear").when(best["share"] > share, best["name"]).otherwise("other")


def _among(words: Column, wanted: Sequence[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*wanted))


def candidate_names(x: Text, genera: Sequence[str] | None = None) -> Column:
    """Candidate two-word names, each as often as it stands: a capitalised word of four letters or more and a lower-case one; of known genera only, if given."""
    pairs = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"\b[A-Z][a-z]{3,}\s+[a-z]{4,}\b"), F.lit(0))
    names = F.transform(pairs, lambda p: F.regexp_replace(p, r"\s+", " "))
    return names if genera is None else F.filter(names, lambda n: F.substring_index(n, " ", 1).isin(*genera))


def sentences(x: Text) -> Column:
    """Sentences: after a full stop and before a capital, digit or bracket, and at blank lines."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"(?<=[.!?])\s+(?=[A-Z0-9\[(])|\n{2,}"), lambda s: F.trim(s) != "")


def share_of(x: Text, characters: str = "0-9") -> Column:
    """Share of a text's characters that are in the class."""
    return F.try_divide(F.length(F.regexp_replace(_c(x), f"[^{characters}]", "")), F.length(_c(x)))


def recode(x: Text, mapping: Mapping[str, str], default: Text | None = None) -> Column:
    """The mapped value, else ``default``, else the value itself."""
    chain = None
    for key, value in mapping.items():
        chain = F.when(_c(x) == key, value) if chain is None else chain.when(_c(x) == key, value)
    rest = _c(x) if default is None else default if isinstance(default, Column) else F.lit(default)
    return rest if chain is None else chain.otherwise(rest)


def blank(x: Text) -> Column:
    """True for null, white space and the word ``nan``."""
    return F.coalesce(F.trim(_c(x)).isin("", "nan"), F.lit(True))


def typed_value(x: Text, mapping: Mapping[str, str], prefixes: Mapping[str, str] | None = None) -> Column:
    """One answer as its token: the mapping of known labels, else the token of the first prefix it begins with, else as it is; null for blank ones.

    ``prefixes``: beginnings in lower case of values typed over a list of choices, such as ``other``.
    """
    value = F.trim(_c(x))
    chain = F.when(blank(x), F.lit(None).cast("string"))
    for label, token in mapping.items():
        chain = chain.when(value == label, token)
    for start, token in (prefixes or {}).items():
        chain = chain.when(F.lower(value).startswith(start), token)
    return chain.otherwise(value)


def typed_values(x: Text, mapping: Mapping[str, str], prefixes: Mapping[str, str] | None = None) -> Column:
    """Several answers in a cell, by comma or semicolon, as sorted distinct tokens; a known label that holds a comma stays one."""
    value = F.trim(_c(x))
    parts = F.filter(F.transform(F.split(value, r"\s*[;,]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    several = F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, lambda p: typed_value(p, mapping, prefixes)))))
    none = F.array().cast("array<string>")
    return F.when(blank(x), none).when(value.isin(*mapping) if mapping else F.lit(False), F.array(recode(value, mapping))).otherwise(several)


def place_set(x: Text, aliases: Mapping[str, str], missing: Sequence[str] = ("not stated", "unclear", "none", "na")) -> Column:
    """Places of a cell, by semicolon or bar, as sorted distinct plain keys under their usual names; without words for missing ones."""
    keys = F.transform(F.split(F.when(blank(x), "").otherwise(_c(x)), r"\s*[;|]\s*"), lambda p: recode(plain_key(p), aliases))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: ~k.isin("", *missing))))


def place_token(x: Text, aliases: Mapping[str, str], missing: str = "not stated") -> Column:
    """The places of a cell as one label; ``missing`` where it names none, null where it is blank."""
    places = place_set(x, aliases)
    return F.when(~blank(x), F.when(F.size(places) > 0, F.array_join(places, "; ")).otherwise(missing))


def stated(x: Text, negative: Sequence[str] = ("no", "none", "not stated", "na", "n a", "not given", "not reported")) -> Column:
    """Whether a free-text answer gives something: ``yes``, ``no`` for words that deny it, null where it is blank."""
    return F.when(~blank(x), F.when(plain_key(x).isin(*negative), "no").otherwise("yes"))


def html_text(x: Text) -> Column:
    """The visible text of a page: scripts, styles, comments and tags gone, common entities read, squished."""
    bare = F.regexp_replace(_c(x), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return squish(bare)


def salvage_json(x: Text, schema: str) -> Column:
    """The object between the first and the last brace of a text, parsed by ``schema``; null where it can't be."""
    return F.from_json(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?s)\{.*\}", 0), schema)


def json_urls(x: Text, deepest: int = 12) -> Column:
    """All distinct strings that begin with http among the values (not the keys) of any JSON text, down to ``deepest`` levels.

    The text is parsed, so escaped slashes read as slashes.  A level is taken apart as a list or else as an
    object; text that is no JSON has none.
    """
    level = F.array(F.try_parse_json(F.coalesce(_c(x), F.lit(""))))
    found = F.array().cast("array<string>")
    for depth in range(deepest):
        strings = F.filter(F.transform(level, lambda v: F.try_variant_get(v, "$", "string")), lambda v: v.startswith("http"))
        found = F.concat(found, strings)
        if depth + 1 < deepest:
            inside = F.transform(level, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>")))
            level = F.flatten(inside)
    return F.array_distinct(found)

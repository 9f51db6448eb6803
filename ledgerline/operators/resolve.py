"""Names against a taxonomy: hierarchy, synonyms, abbreviations, dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators.joins import small, unique_by


def backfill_from_parent(nodes: DataFrame, node: str, parent: str, columns: Sequence[str], rounds: int = 40) -> DataFrame:
    """Blank attributes filled from the nearest ancestor that has them; cycles and self-parents end without a value.

    Pointers double each round (a node's pointer jumps to its pointer's pointer), so ``rounds`` levels take
    log2(rounds) joins.  Stops when a round fills nothing more.  A round's state is a checkpoint, or kept on the
    executors' disks where the session names no folder for checkpoints, so no round is computed twice.
    """
    own = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in columns]
    state = unique_by(nodes.select(F.col(node).alias("_n"), F.when(F.col(parent) != F.col(node), F.col(parent)).alias("_p"), *own), ["_n"])
    saved, have, reach = _checkpointed(nodes), None, 1
    while reach <= rounds:
        up = state.select(F.col("_n").alias("_p"), F.col("_p").alias("_pp"), *(F.col(c).alias(f"_{c}") for c in columns))
        state = state.join(up, "_p", "left").select("_n", F.col("_pp").alias("_p"), *(F.coalesce(c, f"_{c}").alias(c) for c in columns))
        reach *= 2
        state = state.checkpoint() if saved else state.persist(StorageLevel.DISK_ONLY)
        if (now := state.agg(*(F.count(c) for c in columns)).first()) == have:
            break
        have = now
    rest = [c for c in nodes.columns if c not in columns]
    return nodes.select(*rest).join(state.withColumnRenamed("_n", node).drop("_p"), node, "left").select(nodes.columns)


def _checkpointed(df: DataFrame) -> bool:
    """Whether the session has a folder for checkpoints."""
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def rank_from_lineage(nodes: DataFrame, node: str, parent: str, rank: str, name: str, wanted: Sequence[str], rounds: int = 60) -> DataFrame:
    """For each wanted rank a column with the name of the nearest ancestor (or self) of that rank."""
    seeded = nodes.select(node, parent, *(F.when(F.lower(rank) == w, F.col(name)).alias(w) for w in wanted))
    return nodes.join(backfill_from_parent(seeded, node, parent, wanted, rounds).drop(parent), node, "left")


def earliest_year(nodes: DataFrame, node: str, original: str, year: str) -> DataFrame:
    """The smaller of a name's own year and its original name's."""
    base = nodes.select(F.col(node).alias(original), F.col(year).alias("_base"))
    return nodes.join(small(base), original, "left").withColumn(year, F.least(year, "_base")).drop("_base").select(nodes.columns)


def accepted_names(taxonomy: DataFrame, name: str, node: str, order: str, accepted: Column) -> DataFrame:
    """(key, id, name): accepted names by canonical form, the first by ``order`` wins."""
    rows = taxonomy.where(accepted).select(T.canonical_binomial(name).alias("key"), F.col(node).alias("id"), F.col(name).alias("name"), order).where("key != ''")
    return unique_by(rows, ["key"], [order, "id"]).drop(order)


def resolve_names(tokens: DataFrame, token: str, group: str, accepted: DataFrame, synonyms: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Each token's accepted id and name, with method, confidence, ambiguity.

    accepted: (key, id, name); synonyms: (key, id) of the accepted name.  Order of methods: empty, alias,
    accepted (1.0), synonym (0.95), abbreviation ``x. epithet`` (0.75; 0.55 where several names fit and the
    group's other genera don't settle it), no match (0; null tokens too).  Distinct tokens are resolved once
    and joined back; only abbreviations look at the group, by an equi-join on (initial, epithet) and genus.
    """
    key = T.canonical_binomial(token)
    if aliases:
        key = T.recode(F.lower(T.squish(token)), aliases, key)
    # Each distinct token once, whatever its group.
    known = F.lower(T.squish(token)).isin(*aliases) if aliases else F.lit(False)
    distinct = tokens.select(token).where(F.col(token).isNotNull()).distinct().select(token, key.alias("key"), known.alias("_alias"))
    exact = accepted.select("key", F.col("id").alias("_aid"), F.col("name").alias("_aname"))
    syn = unique_by(synonyms.select("key", F.col("id").alias("_sid")), ["key"]).join(small(accepted.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"))), "_sid")
    out = distinct.join(small(exact), "key", "left").join(small(syn), "key", "left")
    # Abbreviations: the names that fit, and of these the ones whose genus the group has too.
    parts = lambda c: (F.substr(c, F.lit(1), F.lit(1)).alias("_i"), F.regexp_extract(c, r"^\S+ (\S+)", 1).alias("_e"))
    index = accepted.where(F.col("key").rlike(r"^\S{2,} \S+")).select(*parts(F.col("key")), F.struct(F.col("id").alias("id"), F.col("name").alias("name")).alias("_name"), F.regexp_extract("key", r"^\S+", 0).alias("_genus"))
    short = out.where(F.col("_aid").isNull() & F.col("_sid").isNull() & F.col("key").rlike(r"^\p{L}\. \S+")).select(token, *parts(F.col("key")))
    fits = short.join(small(index), ["_i", "_e"]).select(token, "_name", "_genus")
    best = fits.groupBy(token).agg(F.count("*").alias("_n"), F.min_by("_name", "_name.id").alias("_best"))
    full = distinct.where(F.col("key").rlike(r"^\p{L}{2,}")).select(token, F.regexp_extract("key", r"^\S+", 0).alias("_genus")).join(small(fits.select("_genus").distinct()), "_genus", "left_semi")
    genera = tokens.select(group, token).join(small(full), token).select(group, "_genus").distinct()
    asked = tokens.select(group, token).join(small(fits), token).distinct()
    near = asked.join(genera, [group, "_genus"]).groupBy(group, token).agg(F.count("*").alias("_m"), F.min_by("_name", "_name.id").alias("_near"))
    out = out.withColumnRenamed("key", "_key")
    result = tokens.join(small(out), token, "left").join(small(best), token, "left").join(small(near), [group, token], "left")
    sure = (F.col("_n") == 1) | F.coalesce(F.col("_m") == 1, F.lit(False))
    method = F.when(F.col("_key") == "", "empty").when(F.col("_aid").isNotNull(), F.when(F.col("_alias"), "alias").otherwise("accepted")).when(F.col("_sid").isNotNull(), "synonym").when(F.col("_n").isNotNull(), "abbreviation").otherwise("no_match")
    confidence = F.when(F.col("_aid").isNotNull(), 1.0).when(F.col("_sid").isNotNull(), 0.95).when(sure, 0.75).when(F.col("_n").isNotNull(), 0.55).otherwise(0.0)
    chosen = F.coalesce("_near", "_best")
    found = [F.coalesce("_aid", "_sid", chosen["id"]).alias("resolved_id"), F.coalesce("_aname", "_sname", chosen["name"]).alias("resolved_name"), method.alias("method"), confidence.alias("confidence")]
    return result.select(*tokens.columns, *found, F.coalesce(~sure & F.col("_n").isNotNull(), F.lit(False)).alias("is_ambiguous"), F.coalesce("_n", F.lit(0)).alias("candidates"))


def review_queue(resolved: DataFrame) -> DataFrame:
    """Tokens a person should look at: without a match, or ambiguous."""
    return resolved.where("method = 'no_match' or is_ambiguous")


def ngrams(words: Column, sizes: Sequence[int], firsts: Sequence[str] | None = None) -> Column:
    """All runs of as many words as ``sizes`` says; only those that begin with one of ``firsts``, if given."""
    n = F.size(words)
    if firsts is None:
        starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    else:
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*firsts), i + 1)), lambda i: i.isNotNull())
    runs = [F.transform(F.filter(starts, _fits(n, k)), _run(words, k)) for k in sizes]
    return F.concat(F.array().cast("array<string>"), *runs)


def _fits(n: Column, k: int):
    return lambda i: i <= n - k + 1


def _run(words: Column, k: int):
    return lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")


#: First words of terms that travel as literals; with more of them every run of words is joined.
FIRST_WORDS = 5_000


def dictionary_match(df: DataFrame, key: str, texts: Sequence[str], dictionary: DataFrame, most_words: int | None = None, shortest: int = 3) -> DataFrame:
    """(key, term, value): dictionary terms found as whole words in the texts.

    Runs of words are matched by an equi-join, so the cost does not grow with the dictionary as a scan per
    term would; each row's distinct runs only, of the lengths that the dictionary holds (``most_words`` leaves
    out longer terms), and only those that begin as some term does, where the first words of terms are few.
    """
    words = F.concat(*(T.tokens(c) for c in texts)) if len(texts) == 1 else F.flatten(F.array(*(F.concat(T.tokens(c), F.array(F.lit("|"))) for c in texts)))
    terms = unique_by(dictionary.select(F.lower("term").alias("term"), "value"), ["term"]).where(F.length("term") >= shortest)
    shape = terms.select(F.size(F.split("term", " ")).alias("size"), F.substring_index("term", " ", 1).alias("first"))
    sizes = sorted(r[0] for r in shape.select("size").distinct().collect())
    sizes = [k for k in sizes if most_words is None or k <= most_words]
    firsts = [r[0] for r in shape.select("first").distinct().limit(FIRST_WORDS + 1).collect()]
    # The words are a column of their own, so they are split once and not for every run.
    runs = ngrams(F.col("_words"), sizes, firsts if len(firsts) <= FIRST_WORDS else None)
    each = df.select(key, words.alias("_words")).select(key, F.explode(F.array_distinct(runs)).alias("term"))
    return each.join(small(terms), "term").select(key, "term", "value").distinct()


def profile_columns(columns: Sequence[str], profiles: Mapping[str, Mapping[str, str]]) -> tuple[str, dict[str, str]]:
    """The profile ({canonical: own name}) most of whose columns are there, and the part of it that applies."""
    have = set(columns)
    best = max(profiles, key=lambda p: sum(c in have for c in profiles[p].values()))
    return best, {k: c for k, c in profiles[best].items() if c in have}


def normalised(df: DataFrame, profiles: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Any of several exports of one kind of table as the canonical columns; what a profile lacks is null."""
    _, own = profile_columns(df.columns, profiles)
    names = list(dict.fromkeys(k for p in profiles.values() for k in p))
    return df.select(*((F.col(f"`{own[n]}`") if n in own else F.lit(None)).cast("string").alias(n) for n in names))


def skip_review(x: str | Column, protected: Sequence[str] = (), aliases: Sequence[str] = (), phrases: Sequence[str] = (), prefixes: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    """Whether a token needs no review: protected names always do; aliases, known phrases, prefixes and patterns don't."""
    value = F.lower(T.squish(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))))
    skip = (value == "") | value.isin(*aliases) | value.isin(*phrases)
    for p in prefixes:
        skip = skip | value.startswith(p)
    for p in patterns:
        skip = skip | value.rlike(p)
    return F.when(value.isin(*protected), False).otherwise(skip)


def usable_nodes(taxonomy: DataFrame, kingdom: str, rank: str, status: str, kingdoms: Sequence[str], ranks: Sequence[str], bad: Sequence[str] = ("misapplied",)) -> DataFrame:
    """Nodes of the wanted kingdoms and ranks whose status is not a bad one; a blank status counts as accepted."""
    state = F.lower(F.coalesce(F.trim(status), F.lit("")))
    return taxonomy.where(F.lower(kingdom).isin(*kingdoms) & F.lower(rank).isin(*ranks) & ~state.isin(*bad))


def coded(df: DataFrame, name: str, overrides: Mapping[str, str], dictionary: DataFrame, code: str, most_words: int | None = None) -> DataFrame:
    """A code per name: overrides first, else the code of the longest dictionary term in the name (smallest on a tie)."""
    key = F.lower(T.squish(name))
    rows = df.withColumn("_name", key)
    found = dictionary_match(rows.select("_name").distinct().withColumn("_text", F.col("_name")), "_name", ["_text"], dictionary, most_words)
    best = found.groupBy("_name").agg(F.min_by("value", F.struct(-F.length("term"), F.col("value"))).alias("_code"))
    fixed = T.recode(F.col("_name"), overrides, F.lit(None).cast("string")) if overrides else F.lit(None).cast("string")
    return rows.join(best, "_name", "left").withColumn(code, F.coalesce(fixed, F.col("_code").cast("string"))).drop("_name", "_code")

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ledgerline.operators import agreement, dedup, extract, joins, nested, resolve, rules, sampling, stats, summaries


def test_ledger_adds_up(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, None, "z"), (5, "b", "")], "id int, doi string, text string")
    pipeline = dedup.DedupPipeline([dedup.Stage("usable", keep=F.col("text") != ""), dedup.Stage("doi", key=F.col("doi")), dedup.Stage("text", key=F.col("text"))], ["id"])
    kept, removed, ledger = pipeline.run(rows)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    assert sorted((r["id"], r["removed_by"]) for r in removed.collect()) == [(2, "doi"), (4, "text"), (5, "usable")]
    assert [(r["stage"], r["rows_in"], r["rows_out"]) for r in ledger.orderBy("step").collect()] == [("usable", 5, 4), ("doi", 4, 3), ("text", 3, 2)]


def test_filters_keep_every_row_once(spark):
    df = spark.range(20).withColumn("g", F.col("id") % 4)
    cascade = rules.FilterCascade([("small", F.col("id") < 5), ("even", F.col("id") % 2 == 0)])
    kept, rejected = cascade.apply(df)
    assert kept.count() + rejected.count() == 20
    last = cascade.attrition("g").orderBy("step").collect()
    assert [(r["rule"], r["lost"], r["left"]) for r in last] == [("small", 4, 0), ("even", 0, 0)]


def test_repair(spark):
    cases = {
        "a|b|10.1/x|m1|m2|y|z": ["b", "10.1/x", "m1", "m2", "y", "z"],
        "10.1/x|m1|m2|m3|y|z": ["", "10.1/x", "m1", "m2, m3", "y", "z"],
        "q|10.1/x|y|z": ["q", "10.1/x", "", "", "y", "z"],
        "q|10.1/x|z": ["q", "10.1/x", "", "", "z", ""],
        "no|anchor": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").withColumn("r", nested.repair_row(F.split("l", r"\|"), 6, r"^10\.", before=1, after=2))
    assert {r["l"]: r["r"] for r in df.collect()} == cases


def test_expand_product(spark):
    df = spark.createDataFrame([(1, "old", "t"), (2, "old", "t")], "id int, country string, tissue string")
    found = {"country": F.when(F.col("id") == 1, F.array(F.lit("FR"), F.lit("DE"))).otherwise(F.array(F.lit("ES"))), "tissue": F.when(F.col("id") == 1, F.array(F.lit("leaf"), F.lit("root")))}
    got = sorted((r["id"], r["country"], r["tissue"]) for r in nested.expand_product(df, found).collect())
    assert got == [(1, "DE", "leaf"), (1, "DE", "root"), (1, "FR", "leaf"), (1, "FR", "root"), (2, "ES", "t")]


def test_hierarchy_cycles_and_depth(spark):
    nodes = [(i, i - 1, "p" if i == 0 else None) for i in range(41)] + [(100, 101, None), (101, 100, None), (200, 200, None)]
    out = {r["id"]: r["phylum"] for r in resolve.backfill_from_parent(spark.createDataFrame(nodes, "id int, parent int, phylum string"), "id", "parent", ["phylum"]).collect()}
    assert all(out[i] == "p" for i in range(41)) and out[100] is None and out[200] is None


def test_resolution(spark):
    accepted = spark.createDataFrame([("aspergillus niger", 1, "Aspergillus niger"), ("agaricus niger", 2, "Agaricus niger"), ("oryza sativa", 3, "Oryza sativa")], "key string, id int, name string")
    synonyms = spark.createDataFrame([("old name", 3)], "key string, id int")
    tokens = spark.createDataFrame([(1, "A. niger"), (1, "Aspergillus sp."), (2, "A. niger"), (2, "rice"), (2, "Old name"), (2, "zzz yyy"), (2, "")], "paper int, token string")
    out = {(r["paper"], r["token"]): (r["resolved_id"], r["method"], r["confidence"]) for r in resolve.resolve_names(tokens, "token", "paper", accepted, synonyms, {"rice": "oryza sativa"}).collect()}
    assert out[1, "A. niger"] == (1, "abbreviation", 0.75)
    assert out[2, "A. niger"][1:] == ("abbreviation", 0.55)
    assert out[2, "rice"] == (3, "alias", 1.0) and out[2, "Old name"] == (3, "synonym", 0.95)
    assert out[2, "zzz yyy"] == (None, "no_match", 0.0) and out[2, ""][1] == "empty"


def test_complete_and_pairs(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "x string, y int, n int")
    assert sorted((r["x"], r["y"], r["n"]) for r in joins.complete(df, ["x", "y"], {"n": 0}).collect()) == [("a", 1, 5), ("a", 2, 0), ("b", 1, 0), ("b", 2, 7)]
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (3, None)], "g int, i string")
    assert [tuple(r) for r in joins.pairs_within(sets, "g", "i").collect()] == [("a", "b", 2)]
    large = spark.range(40).select(F.lit(1).alias("g"), "id").union(spark.range(0, 40, 3).select(F.lit(2), "id"))
    got = {(r["a"], r["b"]): r["n"] for r in joins.pairs_within(large, "g", "id", most=6).collect()}
    assert got == {(a, b): 1 + (a % 3 == 0 and b % 3 == 0) for b in range(40) for a in range(b)}


def test_quartiles_differ_as_they_should(spark):
    df = spark.range(227).withColumn("m", F.col("id").cast("double"))
    sizes = lambda f: [r["n"] for r in f(df, "m", "id").groupBy("tile").agg(F.count("*").alias("n")).orderBy("tile").collect()]
    assert sizes(summaries.quartiles) == [57, 57, 57, 56]
    assert sizes(summaries.cut_quantiles) == [57, 57, 56, 57]


def test_probabilities():
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.binomial_two_sided(8, 10, 0.5) == pytest.approx(0.109375)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-9)
    assert stats.correlation_p(0.5, 20) == pytest.approx(0.024769558, abs=1e-8)
    assert 0 < stats.permutation_p([[10, 2], [3, 15]], 500) < 0.02


def test_allocation():
    assert sum(sampling.allocate({"a": 50, "b": 30, "c": 3}, 20).values()) == 20
    assert sampling.allocate({"a": 1, "b": 1}, 10) == {"a": 1, "b": 1}
    assert sampling.largest_remainder({"a": 3, "b": 2, "c": 2}, 10) == {"a": 4, "b": 3, "c": 3}
    drawn = sampling.quota_draw([{"k": "x"}, {"k": "x"}, {"k": "y"}], 2, {"k": {"x": 1, "y": 1}}, "k")
    assert [r["k"] for r in drawn] == ["x", "y"]


def test_agreement_extremes(spark):
    same = spark.createDataFrame([(i, "a" if i % 2 else "b", 3) for i in range(10)], "item int, k string, n int")
    row = agreement.agreement(same, ["item"], "k").first()
    assert row["fleiss_kappa"] == pytest.approx(1) and row["gwet_ac1"] == pytest.approx(1)
    low, high = agreement.bootstrap_interval([0.0, 1.0] * 20, lambda v: sum(v) / len(v), 500)
    assert low < 0.5 < high


def test_records_and_claims(spark):
    df = spark.createDataFrame([("1. A. Title: x\n\n2. B. Title: y\n",)], "t string")
    out = extract.records(df, "t", r"\n\n(?=\d+\.\s)", {"title": r"Title: (\w+)"})
    assert [r["title"] for r in out.orderBy("record_no").collect()] == ["x", "y"]
    texts = spark.createDataFrame([(1, "All plants have fungi. Maybe most."), (2, None)], "id long, t string")
    model = lambda rows: ({"key": k, "is_claim": "all" in t.lower()} for k, t in rows)
    got = extract.claims(texts, "id", "t", model, "key long, is_claim boolean").orderBy("key").collect()
    assert [(r["key"], r["is_claim"]) for r in got] == [(1, True), (2, False)]
    got = extract.keyword_claims(texts, "id", "t", ["all", "most"], ["maybe"]).orderBy("key").collect()
    assert [(r["key"], r["is_claim"], r["found"], r["hedged"], r["confidence"], r["evidence"]) for r in got] == [(1, True, 2, 1, 0.75, ["All plants have fungi", "Maybe most."]), (2, False, 0, 0, 0.0, [])]


def test_profiles():
    profiles = {"plain": {"id": "taxonID", "name": "canonicalName"}, "archive": {"id": "dwc:taxonID", "name": "dwc:scientificName"}}
    assert resolve.profile_columns(["dwc:taxonID", "x"], profiles) == ("archive", {"id": "dwc:taxonID"})


def test_long_dictionary_terms(spark):
    names = ["Georgia", "Congo", "Democratic Republic of Congo", "Saint Vincent and the Grenadines", "South Georgia and the South Sandwich Islands"]
    dictionary = spark.createDataFrame([(n, n[:2].upper() + str(len(n.split()))) for n in names] + [(None, "none")], "term string, value string")
    texts = spark.createDataFrame([(i, f"Found in {n}, twice.") for i, n in enumerate(names)] + [(9, None)], "id long, text string")
    found = {(r["id"], r["term"]) for r in resolve.dictionary_match(texts, "id", ["text"], dictionary).collect()}
    assert found == {(i, n.lower()) for i, n in enumerate(names)} | {(2, "congo"), (4, "georgia")}
    codes = {r["id"]: r["code"] for r in resolve.coded(texts, "text", {}, dictionary, "code").collect()}
    assert codes == {0: "GE1", 1: "CO1", 2: "DE4", 3: "SA5", 4: "SO7", 9: None}


def test_quota_draw_looks_at_every_document(spark, tmp_path):
    import hashlib

    from ledgerline.plans.registry import QUERIES

    # Of 6,000 rows, 5,800 are of one source and language; the others are rare.
    rows = [(i, "en", "hot") if i % 30 else (i, ["fr", "de", "es", None, "en"][i // 30 % 5], f"s{i // 30 % 19}") for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    order = [{"doc_id": i, "lang": x, "source": s} for i, x, s in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}q".encode()).hexdigest(), r[0]))]
    quotas = {"lang": sampling.largest_remainder({"en": 3, "fr": 1, "de": 1, "es": 1}, 40), "source": {r["source"]: 4 for r in order}}
    want = [tuple(r.values()) for r in sampling.quota_draw(order, 40, quotas, "doc_id")]
    got = [tuple(r) for r in QUERIES["quota_draw"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {x: sum(r[1] == x for r in got) for x in quotas["lang"]} == quotas["lang"]


def test_many_rows_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SALTS", 4)
    rows = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    pipeline = dedup.DedupPipeline([dedup.Stage("key", key=F.col("k")), dedup.Stage("tens", key=F.floor(F.col("id") / 10))], [F.desc("id")])
    kept, removed, ledger = pipeline.run(rows)
    first = {499} | {i for i in range(0, 500, 5)}
    best = {}
    for i in first:
        best[i // 10] = max(best.get(i // 10, -1), i)
    assert sorted(r["id"] for r in kept.collect()) == sorted(best.values())
    assert [(r["rows_in"], r["rows_out"]) for r in ledger.orderBy("step").collect()] == [(500, 101), (101, 50)]


def test_snippets_by_plain_loops(spark):
    import random
    import re

    r = random.Random(2)
    texts = ["".join(r.choice(["key", "word ", "x", "zz ", "é"]) for _ in range(r.randint(0, 120))) for _ in range(60)] + [None, "", "key" * 400]
    got = {(x["i"], x["place"]): (x["start"], x["end"], x["snippet"]) for x in extract.snippets(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", "key", window=7, most=3, budget=40).collect()}
    want = {}
    for i, t in enumerate(texts):
        merged = []
        for m in re.finditer("key", t or ""):
            s, e = max(m.start() - 7, 0), min(m.end() + 7, len(t))
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        left = 40
        for k, (s, e) in enumerate(merged[:3]):
            if left > 0:
                want[i, k + 1] = (s, min(e, s + left), t[s : min(e, s + left)])
            left -= e - s
    assert got == want and len(want) > 60
    spans = extract.hit_spans(spark.createDataFrame([("ab" * 1000,)], "t string"), "t", "b", "h").first()["h"]
    assert [(x["start"], x["end"]) for x in spans] == [(2 * i + 1, 2 * i + 2) for i in range(1000)]


def test_dictionary_with_many_first_words(spark, monkeypatch):
    dictionary = spark.createDataFrame([(f"word{i} tail", str(i)) for i in range(30)] + [("alone", "a")], "term string, value string")
    texts = spark.createDataFrame([(1, "x word tail alone wordc tail"), (2, None)], "id int, text string")
    dictionary = dictionary.withColumn("term", F.translate("term", "0123456789", "abcdefghij"))
    few = sorted(map(tuple, resolve.dictionary_match(texts, "id", ["text"], dictionary).collect()))
    monkeypatch.setattr(resolve, "FIRST_WORDS", 3)
    assert few == sorted(map(tuple, resolve.dictionary_match(texts, "id", ["text"], dictionary).collect())) == [(1, "alone", "a"), (1, "wordc tail", "2")]


@pytest.mark.parametrize("falling", [False, True])
def test_order_by_ranges_is_the_order_of_one_window(spark, falling):
    from ledgerline.operators import ranks

    rows = spark.range(700).select("id", F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 50).cast("double")).alias("v"), (F.col("id") % 4).alias("m")).withColumn("v", F.when(F.col("id") == 5, float("nan")).otherwise(F.col("v")))
    one, many = (sorted(map(tuple, ranks.ordered(rows, "v", ["id"], measure="m", falling=falling, limit=limit).select("id", "_place", "_before", "_total").collect())) for limit in (1 << 40, 0))
    assert one == many and len({r[1] for r in one}) == 700
    empty = ranks.ordered(rows.where("false"), "v", limit=0)
    assert empty.count() == 0
    alike = ranks.ordered(rows.withColumn("v", F.lit(1.0)), "v", ["id"], limit=0)
    assert sorted(r["_place"] for r in alike.collect()) == list(range(1, 701))


def test_ranks_of_values_that_differ_when_computed_again(spark):
    import random

    noise = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(90).select((F.col("id") * 1.0).alias("x"), noise(F.col("id") * 2.0).alias("y"), F.when(F.col("id") < 30, "a").otherwise("b").alias("g"))
    assert tuple(stats.spearman(rows, "x", "y").first()) == (90, pytest.approx(1))
    assert sorted(map(tuple, stats.spearman_matrix(rows.withColumn("z", -F.col("y")), ["x", "y", "z"]).collect())) == [("x", "y", 90, pytest.approx(1)), ("x", "z", 90, pytest.approx(-1)), ("y", "z", 90, pytest.approx(-1))]
    assert stats.kruskal(rows, "y", "g").first()["h"] == pytest.approx(stats.kruskal(rows, "x", "g").first()["h"])
    assert stats.rank_sum(rows, "y", "g", "b").first()["u"] == 1800 and stats.signed_rank(rows, "y", "x").first()["w_plus"] == 45 * 91


def test_only_stored_rows_are_not_written_again(spark):
    from ledgerline import scratch

    stored = spark.read.parquet(f"{DATA}/orders.parquet").where("o_totalprice > 5").select((F.col("o_totalprice") / 2).alias("v"))
    before = len(scratch.WRITTEN)
    assert scratch.once(stored, "kept") is stored and len(scratch.WRITTEN) == before
    assert scratch.once(stored.groupBy().sum("v"), "sums").count() == 1 and len(scratch.WRITTEN) == before + 1

"""The cases every training-data operator must bear: clashing names, repeated rows and ids, long texts, hubs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, common, minhash_dedup, mixing, pii, suffix_dedup, token_counts, topk, toxicity, url_filter, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, and some more.
HELPERS = """id twin row key n part copies alike own_key own_id row_id nth _nth _at _row _text _findings _email _email_chunks _card_sizes _pieces _chunks findings _key _copies _n _own
sig marks set spots spot component comp family tree bucket base piece last ids h tile label y score verdict kept leaf whole target size source_size""".split()


def texts_of(n=40):
    r = random.Random(3)
    words = ["alpha", "beta", "card 4111 1111 1111 1111", "a@b.co", "漢字", "+1 234 567 8901", "you", "moron", "1.2.3.4"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*texts, None, "", texts[0], texts[1] + " more", "x" * 3000, "word " * 20_000]


def plain_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "st"[i % 2], 0) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def both(spark):
    docs = plain_docs(spark, texts_of()).cache()
    return docs, docs.select("*", *(F.lit("x").alias(h) for h in HELPERS)).cache()


MODEL = toxicity.Model({"moron": 2.0}, 0.1)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: pii.find(d).select("doc_id", "findings"), lambda d: pii.redact(d), token_counts.count_tokens, suffix_dedup.remove_repeats, lambda d: toxicity.score(d, MODEL), lambda d: toxicity.clean(d, MODEL),
        lambda d: byte_bpe.encode(d, chunk=500, overlap=20), minhash_dedup.near_duplicates, minhash_dedup.one_of_each,
    ],
    ids=["find", "redact", "count_tokens", "remove_repeats", "score", "clean", "encode", "near_duplicates", "one_of_each"],
)
def test_other_columns_change_nothing(both, operator):
    plain, clashing = (operator(d) for d in both)
    assert not [c for c in plain.columns if c not in clashing.columns]
    rows = lambda d: sorted(map(repr, d.select(plain.columns).collect()))
    assert rows(plain) == rows(clashing)
    if "lang" in plain.columns:
        assert clashing.columns == both[1].columns


def test_mix_passes_other_columns(both):
    for docs in both:
        mix, rows = mixing.mix(docs), mixing.mixed(docs).collect()
        assert mix.columns == docs.columns
        assert Counter(r["doc_id"] for r in mix.collect()) == Counter({r["row_id"]: r["copies"] for r in rows if r["copies"]})


def test_keep_named_findings_gives_way(both):
    found = pii.find(both[1], keep=("lang", "findings"))
    assert found.columns == ["doc_id", "text", "lang", "findings"] and found.schema["findings"].dataType.typeName() == "array"


def test_vector_operators_ignore_other_columns(spark):
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, r.normal(size=8).tolist(), i % 2) for i in range(80)], "vec_id long, embedding array<double>, label int")
    other = vectors.select("*", *(F.lit("x").alias(h) for h in [*HELPERS, "dim", "block", "rows", "vector", "weight", "angle", "low", "high", "kind", "group", "cell"] if h not in vectors.columns))
    for f in (vector_dedup.near_duplicates, lambda v: topk.top_k(v, F.col("vec_id") % 10 == 0)):
        assert sorted(map(repr, f(vectors).collect())) == sorted(map(repr, f(other).collect()))


def test_no_shared_folder_on_a_cluster(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, master, folder=None):
            self.conf = Conf({})
            self.sparkContext = type("C", (), {"master": master, "getConf": lambda _: Conf({"spark.checkpoint.dir": folder})})()

    with pytest.raises(ValueError):
        common.scratch(Session("spark://host:7077"))
    assert common.scratch(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert common.scratch(Session("local[2]")).endswith(common.LOCAL_SCRATCH)


# --- PII ------------------------------------------------------------------------------------------------


def test_pii_many_matches_and_repeated_rows(spark):
    many = "".join(f"u{i}@h{i}.org; " for i in range(20_000))
    edge = " " * (pii.PIECE - 20) + "social security 123-45-6789 " + "z" * (2 * pii.PIECE) + " ssn: 123-45-6789"
    docs = spark.createDataFrame([(1, many), (2, edge), (2, edge), (None, "a@b.co")], "doc_id long, text string")
    found = pii.find(docs).select("doc_id", F.size("findings").alias("n"), pii.listed(F.slice("findings", 1, 2)).alias("s"), F.expr("transform(slice(findings, 20000, 1), f -> f.end)").alias("end")).collect()
    assert sorted((r["doc_id"] or 0, r["n"]) for r in found) == [(0, 1), (1, 20_000), (2, 2), (2, 2)]
    assert {r["s"] for r in found if r["doc_id"] == 2} == {f"ssn:{edge.index('123')}:{edge.index('123') + 11},ssn:{edge.rindex('123')}:{len(edge)}"}
    assert [r["end"] for r in found if r["doc_id"] == 1] == [[len(many) - 2]]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == "[EMAIL]; " * 20_000 and clean[2] == edge.replace("123-45-6789", "[SSN]") and clean[None] == "[EMAIL]"


def test_pii_redaction_of_overlapping_spans(spark):
    texts = ["+1 4111 1111 1111 1111 x", "1.2.3.4@b.co, 4.4.4.4", "a@1.2.3.4"] + ["a@b.co " * n for n in (127, 128, 129, 257)]
    got = {r["doc_id"]: r for r in pii.find(plain_docs(spark, texts)).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(plain_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for f in got[i]["findings"]:
            if f["start"] >= at:
                out += t[at : f["start"]] + f"[{f['kind'].upper()}]"
                at = f["end"]
        assert clean[i] == out + t[at:]


# --- token counts, BPE, suffixes ------------------------------------------------------------------------------


def test_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_bytes"]) for r in token_counts.count_tokens(docs).collect()) == [(1, 5), (1, 7), (1, 7), (2, 0)]
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.encode(docs).collect()) == [(1, b"one two"), (1, b"one two"), (1, b"three"), (2, b"")]


def test_suffix_repeats_of_repeated_ids(spark):
    r = random.Random(1)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(1, "xx" + passage), (1, "yyyy" + passage + passage), (1, "xx" + passage), (3, passage), (3, "w" * 20)]
    starts = defaultdict(set)
    for i, t in rows:
        for s in range(len(t) - 99):
            starts[t[s : s + 100]].add((i, s))
    want = []
    for i, t in rows:
        marks = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if min(starts[t[s : s + 100]]) < (i, s):
                marks[s : s + 100] = True
        want.append((i, len(t), int(marks.sum())))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got.collect()) == sorted(want)


def test_one_header_before_many_bodies(spark, monkeypatch):
    """Windows at the end of a common header are equal in part and differ in their stretches."""
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    r = random.Random(6)
    header = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, header + "".join(r.choice("xyz") for _ in range(130))) for i in range(60)] + [(70, "q" * 50 + header[100:]), (71, "plain " * 40)]
    rows += [(80, header + "same tail " * 12), (81, header + "same tail " * 12)]
    first, want = {}, {}
    for i, t in rows:
        marks = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if first.setdefault(t[s : s + 100], (i, s)) != (i, s):
                marks[s : s + 100] = True
        want[i] = int(marks.sum())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {x["doc_id"]: x["n_removed"] for x in suffix_dedup.remove_repeats(docs).collect()} == want


def test_only_texts_with_hot_anchors_are_shuffled_for_them(spark):
    rows = spark.range(2000).select("id", F.hash("id").alias("twin"), F.concat(F.lit("漢 "), "id").alias("text"))
    wanted = rows.where("id % 100 = 7").select("id", "twin")
    got = suffix_dedup._likely(rows, wanted)
    assert got.join(wanted, ["id", "twin"]).count() == 20 and got.count() < 40 and got.exceptAll(rows.select("id", "twin", "text")).count() == 0


# --- urls -----------------------------------------------------------------------------------------------------


def brute_ranks(edges, seeds, rounds):
    """Ranks and weights of one kind, in whole numbers, by plain loops."""
    out, total = Counter(), sum(seeds.values())
    for (s, _), n in edges.items():
        out[s] += n
    start = {h: (n * url_filter.UNIT // total, n * url_filter.UNIT) for h, n in seeds.items()}
    now = start
    for _ in range(rounds):
        sums = defaultdict(lambda: [0, 0])
        for (s, d), n in edges.items():
            if s in now:
                for k in (0, 1):
                    sums[d][k] += now[s][k] * n // out[s] * url_filter.FOLLOW
        for h, x in start.items():
            for k in (0, 1):
                sums[h][k] += x[k] * (100 - url_filter.FOLLOW)
        now = {h: (a // 100, b // 100) for h, (a, b) in sums.items()}
    return now


def test_url_ranks_with_a_hub(spark):
    r = random.Random(11)
    hosts = ["hub.org", "bad.net", "good.com", *(f"h{i}.org" for i in range(25))]
    links = Counter()
    for i, h in enumerate(hosts):
        for d in ["hub.org", *r.sample(hosts, 3)]:
            links[h, d] += r.randint(1, 4)
        links["hub.org", h] += 1
    pages, own = [], defaultdict(list)
    for (s, d), n in links.items():
        own[s] += [d] * n
    for i, h in enumerate(hosts):
        path = "/fr/x" if h == "bad.net" else "/x"
        # Half of the links have no scheme of their own; relative ones lead to no host.
        html = "".join(f'<a href="{"" if k % 2 else "https:"}//{d}/p?q">x</a><a href=/y>y</a>' for k, d in enumerate(own[h]))
        pages += [(2 * i, f"http://{h}{path}", html), (2 * i + 1, f"http://{h}{path}", "")]
    links = {(s, d): n for (s, d), n in links.items() if s != d}
    trust = brute_ranks(links, {"good.com": 2}, url_filter.ROUNDS)
    distrust = brute_ranks({(d, s): n for (s, d), n in links.items()}, {"bad.net": 2}, url_filter.ROUNDS)
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 2 * len(hosts)
    for row in got:
        good, bad = trust.get(row["host"], (0, 0)), distrust.get(row["host"], (0, 0))
        assert (row["trust"], row["distrust"]) == (good[0], bad[0])
        if row["rule"] is None:
            assert row["verdict"] == ("block" if bad[1] >= url_filter.LEAST and bad[1] > good[1] else "allow")


def test_url_sql_of_linked_pages(spark, tmp_path):
    from conftest import same_as_sql

    r = random.Random(5)
    hosts = ["bad.net", "good.com", *(f"h{i}.org" for i in range(12))]
    pages = [(i, f"http://{h}/{'es' if h == 'bad.net' else 'a'}/", "".join(f"<a HREF='//{r.choice(hosts)}/'>x</a> <a href=http://{r.choice(hosts)}>" for _ in range(r.randint(0, 4)))) for i, h in enumerate(hosts * 2)]
    pages += [(100, None, None), (101, "no scheme", "x" * 200_000), (101, "no scheme", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = same_as_sql(url_filter.query(spark, str(tmp_path)), url_filter.ORACLE, str(tmp_path))
    assert got == want and len({row[-1] for row in got}) > 1


# --- toxicity ---------------------------------------------------------------------------------------------------


def test_toxicity_features_by_plain_recount():
    lexicon, r = {"moron": 2.0, "idio*": 1.0, "fool": 0.5}, random.Random(2)
    words = ["moron", "Moron!", "m0ron", "idiotic", "fool", "you", "YOUR", "du", "calm", "Ärger", "b@d", "s3t", "...", "a1"]
    reader = toxicity.Reader(lexicon)
    for n in [0, 1, 2, 5, 40, 300]:
        text = " ".join(r.choice(words) for _ in range(n))
        tokens = text.lower().split()
        weight = [max([lexicon.get(t, 0.0) for t in toxicity.terms(w.strip(toxicity.EDGES))] or [0.0]) if w.strip(toxicity.EDGES) else 0.0 for w in tokens]
        hits = [i for i, w in enumerate(weight) if w]
        you = [w.strip(toxicity.EDGES) in toxicity.SECOND_PERSON for w in tokens]
        near = sum(any(you[j] for j in range(len(tokens)) if abs(i - j) <= toxicity.NEAR) for i in hits)
        got = dict(zip(toxicity.FEATURES, reader.features(text)))
        size = max(len(text), 1)
        assert got["hits"] == len(hits) and got["near"] == near and got["weight"] == pytest.approx(sum(weight)) and got["largest"] == max(weight, default=0)
        assert got["density"] == pytest.approx(len(hits) / max(n, 1)) and got["mean"] == pytest.approx(sum(weight) / max(len(hits), 1)) and got["words"] == pytest.approx(np.log1p(n))
        assert got["capitals"] == pytest.approx(sum(c.isupper() for c in text) / size) and got["exclaims"] == pytest.approx(text.count("!") / size)
        assert got["punctuation"] == pytest.approx(sum(c in ".,;:!?*" for c in text) / size) and got["obfuscated"] == pytest.approx(sum(toxicity.obfuscated(w.strip(toxicity.EDGES)) for w in tokens) / max(n, 1))
    assert reader.features("m0ron")[1] == 1 and toxicity.obfuscated("m0ron") and not toxicity.obfuscated("moron")


def test_toxicity_odd_texts_and_labels(spark):
    texts = [f"calm words number {i} here" if i % 2 else f"you moron number {i}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "moron " * 100_000), (0, texts[0]), (0, texts[0]), (None, "x")], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    labels = [(i, 1, int(i % 2 == 0)) for i in range(60)]
    scores = toxicity.score(docs, toxicity.train(docs, label([*labels, labels[3], (7, 1, None), (None, 1, 1), (999, 1, 1)]))).collect()
    by = defaultdict(set)
    for r in scores:
        assert 0 <= r["score"] <= 1
        by[r["doc_id"]].add(r["score"])
    assert len(scores) == 66 and len(by[0]) == 1 and by[100] == by[101] and len(by[102]) == 1
    for y in (0, 1):
        one = toxicity.train(docs, label([(i, 1, y) for i in range(60)]))
        assert {r["score"] for r in toxicity.score(docs, one).collect()} == {float(y)}
    nothing = toxicity.train(docs, label([]))
    assert toxicity.score(docs.where("false"), nothing).count() == 0 and {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


# --- vectors ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("spread,most", [(2.0, 0.4), (0.0, 1.0)])
def test_reading_stops_before_the_end(spread, most):
    """Of skewed lists a part is read; of lists that differ little nearly everything; the best are right in both."""
    r = np.random.default_rng(4)
    n, d, k = 2000, 24, 5
    rows = np.floor(256 * r.normal(size=(n, d)) * np.exp(-spread * np.arange(d)) * r.lognormal(0, spread / 2, (n, 1)))
    lists, ids, queries = topk.Lists(rows), np.arange(n), rows[::100]
    total = 0
    for i, near, scores, read in topk.nearest(queries, ids[::100], lists, ids, k, np.full(len(queries), -np.inf)):
        assert (scores == rows[near] @ queries[i]).all()
        every = sorted((-int(rows[c] @ queries[i]), c) for c in ids if c != 100 * i)[:k]
        assert sorted(zip(-scores.astype(int), near))[:k] == every
        assert read <= n * np.count_nonzero(queries[i])
        total += read / max(n * np.count_nonzero(queries[i]), 1)
    assert total / len(queries) <= most
    # Blocks that can't reach the floor are not read at all.
    assert all(read == 0 for *_, read in topk.nearest(queries, ids[::100], lists, ids, k, lists.most(queries) + 1))


@pytest.mark.parametrize("block,held", [(2048, 1 << 15), (7, 9), (30, 1 << 15)])
def test_top_k_of_repeated_ids(spark, block, held):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(60)]
    rows += [rows[3], rows[20], rows[20], (20, rows[5][1]), (None, rows[4][1])]
    ints = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None]
    want = []
    for i, q in ints:
        if i % 10 == 0:
            best = sorted((-int(q @ c), j) for j, c in ints if j != i)[:5]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, block=block, held=held)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("labels", [["a", "b"], [1.5, -0.0]])
def test_vector_links_of_any_label_and_repeated_ids(spark, labels):
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 10))
    rows = [(i, (base[i % 6] + r.normal(size=10) * 0.15).tolist(), labels[i % 12 // 6]) for i in range(70)]
    rows += [(3, rows[4][1], labels[0]), rows[5], rows[5], (9, rows[8][1], None)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {'string' if labels[0] == 'a' else 'double'}")
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = defaultdict(set)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= vector_dedup.THRESHOLD:
                near[rows[a][0]].add(rows[b][0])
    comp = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
    for most in (1 << 15, 5):
        got = vector_dedup.near_duplicates(frame, most=most).collect()
        assert len(got) == len(rows)
        assert all(r["component_id"] == (comp.get(r["vec_id"], r["vec_id"]) if r["n_links"] or r["vec_id"] != 9 else 9) or r["vec_id"] == 9 for r in got)
        assert all((r["n_links"] > 0) == bool(near[r["vec_id"]]) for r in got if r["vec_id"] not in (3, 9))


# --- near-duplicates and mixing -----------------------------------------------------------------------------------------


def test_rows_of_one_id_lose_no_text_and_no_link(spark):
    r = random.Random(8)
    make = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(80))
    a, b, c = make(), make(), make()
    rows = [(1, a), (1, b), (1, a.upper()), (2, a + " tail"), (3, b + " tail"), (4, c), (4, c), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    comps = {(x["doc_id"], x["component_id"]) for x in minhash_dedup.near_duplicates(docs).collect()}
    assert comps == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    kept = minhash_dedup.one_of_each(docs).collect()
    assert sorted((x["doc_id"] or 0, x["text"].lower()) for x in kept) == sorted([(1, a), (1, b), (4, c), (0, c)])


def test_many_equal_rows_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY", 7)
    docs = spark.createDataFrame([(1, "a b c", "hot", 5)] * 400 + [(2, "d e", "cold", 1), (2, "d e", "cold", 2), (3, None, None, 1)], "doc_id long, text string, source string, extra int")
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 403
    hot = [r["copies"] for r in rows if r["row_id"] == 1]
    assert max(hot) - min(hot) <= 1 and max(hot) <= 2 and abs(3 * sum(hot) - rows[0]["target"] if rows[0]["source"] == "hot" else 0) <= 3
    got = Counter((r["doc_id"], r["extra"]) for r in mixing.mix(docs).collect())
    assert got[1, 5] == sum(hot) and sum(n for (i, _), n in got.items() if i == 2) == sum(r["copies"] for r in rows if r["row_id"] == 2)


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    label = "doc_id long, quality int, toxic int"
    rows = [(i, t, "en", [None, "s", "t"][i % 3], len(t or ""), "x", "y") for i, t in enumerate(texts_of(12))] + [(None, "no id a@b.co", None, None, None, None, None)] * 2
    cases = {"empty": [], "odd": rows + rows[3:5]}
    for name, docs in cases.items():
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, DOCS + ", findings string, _row string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], label).write.parquet(f"{folder}/labels.parquet")
        before, now = len(common.WRITTEN), spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            now = f(spark, now, folder)
            assert now.columns == spark.read.parquet(f"{folder}/documents.parquet").columns, stage
            now = common.cut(now, "odd")
        if docs:
            assert all("@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in now.collect())
        common.discard(spark, since=before)
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids"] and (out.count() > 0) == bool(docs)
        assert len(common.WRITTEN) == before + 1

"""The training-data operators against brute force, on small tables that hold the awkward cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, same_as_sql
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, common, components, minhash_dedup, mixing, pii, registry, suffix_dedup, token_counts, topk, toxicity, url_filter, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    """Documents with clashing extra columns, so that nothing depends on the schema."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", id string, twin int").repartition(3)


def awkward():
    r = random.Random(5)
    words = ["alpha", "béta", "gamma", "delta", "ÉPSILON", "z", "漢字", "don't", "1234", "  ", "\n", "\t"]
    texts = [None, "", " ", "a", "a", "x" * 500, "word " * 3000, "line one\n" * 40]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(60)]
    texts += [texts[20], texts[20], texts[21] + " end", "new start " + texts[22], texts[23][: len(texts[23]) // 2] + "Q" + texts[23][len(texts[23]) // 2 :]]
    return texts


# --- registered queries ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    got, want = same_as_sql(df, registry.ORACLES[name])
    assert got == want


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).where("false")
    assert token_counts.count_tokens(docs).count() == 0
    assert byte_bpe.encode(docs).count() == 0
    assert pii.find(docs).count() == 0 and pii.redact(docs).count() == 0
    assert mixing.mixed(docs).count() == 0 and mixing.mix(docs).count() == 0
    assert minhash_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert topk.top_k(vectors, F.col("vec_id") % 2 == 0).count() == 0
    assert vector_dedup.near_duplicates(vectors).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text that is here twice " * 8, None, None, None), (1, "some text that is here twice " * 8, None, None, None), (1, None, "a", "b", 2)], DOCS)
    for made in (token_counts.count_tokens(docs), byte_bpe.encode(docs), minhash_dedup.near_duplicates(docs), suffix_dedup.remove_repeats(docs), mixing.mixed(docs), pii.find(docs)):
        assert len(made.collect()) == 3
    assert mixing.mix(docs).columns == docs.columns


# --- PII --------------------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            v = m.group()
            d = [int(c) for c in v if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_pii_base_spans(spark):
    r = random.Random(2)
    pieces = ["a@b.co", "@", ".", "x_1.y@é.com", "a.b+c@d-e.f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "00", "+1 (234) 567-8901", "+", "12", "-", " ", "é漢🎉", "+49 30 1234567 ", "0000 0000 0000", "a@b.c+x@d.e", "a@b.c_d@e.f"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, "", "9" * 5000, "a" * 20000, "a@b.c " * 300]
    found = {r["doc_id"]: r["s"] for r in pii.find(docs_of(spark, texts)).select("doc_id", pii.listed(F.filter("findings", lambda s: s["kind"].isin(*pii.BASE))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == ",".join(base_spans(t or "")), t


def test_pii_added_kinds_and_redaction(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 here", "IBAN GB82 WEST 1234 5698 7654 33 here", "my social security number 123-45-6789.", "part 123-45-6789 of", "mail a@b.co or +1 234 567 8901 now", None]
    docs = docs_of(spark, texts)
    kinds = {r["doc_id"]: [f["kind"] for f in r["findings"]] for r in pii.find(docs).collect()}
    assert "iban" in kinds[0] and "iban" not in kinds[1] and kinds[2] == ["ssn"] and kinds[3] == [] and kinds[4] == ["email", "phone"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[4] == "mail [EMAIL] or [PHONE] now" and clean[2] == "my social security number [SSN]." and clean[5] == ""


def test_pii_is_native(spark):
    plan = registry.QUERIES["op1_pii"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- tokens -----------------------------------------------------------------------------------------


def test_token_counts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    texts = awkward() + ["a ", " a", "  a  b ", "▁a▁", "a▁ b", "<s> <unk>", "\x00", "é", "🎉" * 50]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, texts), limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t
    counter = token_counts.Counter(token_counts.model_path())
    assert all(len(library.encode(w[1:])) == 1 for w in counter.whole if w.strip() and w[0] == " ")


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 9), (50, 7), (9, 9)])
def test_byte_bpe(spark, chunk, overlap):
    texts = awkward() + ["x" * 300 + " y" * 50, " " * 400, "a\u0558b 漢字 ١٢", "'s't'll" * 30]
    codec = byte_bpe.Codec(byte_bpe.ranks_path())
    for r in byte_bpe.encode(docs_of(spark, texts), chunk=chunk, overlap=overlap).collect():
        text = texts[r["doc_id"]] or ""
        want = codec.library.encode_ordinary(text)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]) == text.encode()


def test_byte_bpe_stitching_random():
    codec, r = byte_bpe.Codec(byte_bpe.ranks_path()), random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", "'s", "1", "²", "!", "漢", "🎉", "word", " the"]
    for _ in range(300):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 90)))
        want = b"".join(i.to_bytes(4, "little") for i in codec.library.encode_ordinary(text))
        for chunk, overlap in ((5, 2), (7, 7), (16, 8), (3, 0)):
            assert byte_bpe.encode_text(codec, text, chunk, overlap) == want


# --- suffix-array dedup ------------------------------------------------------------------------------


def brute_repeats(texts, length):
    first, gone = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in enumerate(texts)):
        marks = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in first:
                marks[s : s + length] = True
            else:
                first[w] = (i, s)
        gone[i] = marks
    return gone


def test_suffix_dedup(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdef gh") for _ in range(260))
    texts = awkward() + [passage, "x" + passage + "y", passage[:150] + "é" + passage[150:], passage * 3, "ab" * 200, "\x00" * 250, "q" * 99, "q" * 100, "q" * 101]
    gone = brute_repeats(texts, 100)
    for row in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect():
        marks, data = gone[row["doc_id"]], np.frombuffer((texts[row["doc_id"]] or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], marks.astype(int), [0]])) == 1).sum())
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(data), int(marks.sum()), spans)
        assert bytes(row["kept"]) == data[~marks].tobytes()


# --- urls ---------------------------------------------------------------------------------------------


def test_url_rules_and_hosts(spark):
    cases = {
        "http://a.COM/x": ("a.com", "/x", "com/", "allow"), "http://a.com": ("a.com", "", None, "allow"), "https://m.example.com/en/1?q#f": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "http://x.net/fr/?a": ("x.net", "/fr/", "net/fr/", "block"), "http://badnet/fr/": ("badnet", "/fr/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://É.NET:80/es/": ("É.net:80", "/es/", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_url_distrust_spreads_backwards(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">x</a>' for h in hosts)
    pages = [(0, "http://bad.net/es/1", ""), (1, "http://friend.org/", link("bad.net", "bad.net")), (2, "http://good.com/a", link("nice.org")), (3, "http://nice.org/", link("friend.org")), (4, "http://alone.org/", "")]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got["friend.org"]["verdict"] == "block" and got["friend.org"]["distrust"] > got["friend.org"]["trust"]
    assert got["nice.org"]["verdict"] == "allow" and got["alone.org"]["verdict"] == "allow"


def test_url_verdicts_do_not_depend_on_other_pages(spark):
    link = lambda h, n=1: f'<a href="http://{h}/p">x</a>' * n
    pages = [(0, "http://bad.net/es/1", ""), (1, "http://bad.net/en/1", ""), (2, "http://friend.org/", link("bad.net")), (3, "http://good.com/a", link("nice.org", 3)), (4, "http://nice.org/", link("bad.net") + link("good.com", 9))]
    few = spark.createDataFrame(pages, "page_id long, url string, html string")
    other = lambda n, host, path: spark.range(n).selectExpr("-1 - id", f"concat('http://h', id % 50, '.{host}{path}', id)", "''")
    verdicts = lambda df: {r["page_id"]: r["verdict"] for r in url_filter.judge(df).where("page_id >= 0").collect()}
    want = {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert verdicts(few) == want
    assert verdicts(few.union(other(400_000, "net", "/fr/"))) == want
    assert verdicts(few.union(other(400_000, "com", "/"))) == want


def test_url_thin_edges_carry_rank(spark):
    # One link of 4,000,000 from a host is a share below 10**-6.
    edges = spark.createDataFrame([("distrust", "bad.net", "thin.org", 1), ("distrust", "bad.net", "thick.org", 3_999_999)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("distrust", "bad.net", 30_000_000)], "kind string, host string, n long")
    got = {r["host"]: r for r in url_filter.propagate(edges, seeds).collect()}
    assert got["thin.org"]["rank"] == 15 * 10**10 // 4_000_000 * 85 // 100
    assert int(got["thin.org"]["weight"]) == 30_000_000 * 15 * 10**10 // 4_000_000 * 85 // 100 and int(got["bad.net"]["weight"]) == 30_000_000 * 15 * 10**10


# --- toxicity ------------------------------------------------------------------------------------------


def toxic_tables(spark, n=1500):
    r = random.Random(4)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 1
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        if bad:
            for _ in range(r.randint(2, 4)):
                w[r.randrange(len(w))] = r.choice(["moron", "worthless", "vequ" + r.choice(words)])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    import zlib

    docs, labels = toxic_tables(spark)
    scores = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    held = [(r["score"], r["toxic"]) for r in scores if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((s >= 0.5) == bool(t) for s, t in held)
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s, _ in held)


def test_toxicity_never_sees_the_held_out_fold(spark):
    docs, labels = toxic_tables(spark, 400)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_scores_keep_the_true_share_beyond_the_bounds(spark, monkeypatch):
    r = random.Random(6)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(3, 8))) for _ in range(300)]
    # The same words in toxic and clean texts, more often in toxic ones: 10% of 6,000 are toxic.
    bad = [i % 10 == 1 for i in range(6000)]
    texts = [" ".join(r.choice(["moron", "Idle!"]) if r.random() < (0.05 if b else 0.02) else r.choice(words) for _ in range(r.randint(20, 120))) for b in bad]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    mean = lambda: toxicity.score(docs, toxicity.train(docs, labels)).agg(F.avg("score")).first()[0]
    whole = mean()
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 500)
    assert 0.05 < whole < 0.15 and 0.05 < mean() < 0.15


@pytest.mark.parametrize("text", ["ÉCOUTE Ärger ЖУК ok Ⅷ 𝐀", "PLAIN Ascii", ""])
def test_capitals_count_alike_at_every_length(text):
    for times in (1, 2, 10, 50):
        assert toxicity._capitals(text * times) == sum(map(str.isupper, text)) * times


def test_isotonic_weights_are_repeats():
    r = np.random.default_rng(1)
    x, y, w = r.normal(size=200), (r.random(200) < 0.5).astype(float), r.integers(1, 5, 200)
    a, b = toxicity.isotonic(x, y, w.astype(float)), toxicity.isotonic(np.repeat(x, w), np.repeat(y, w))
    # Repeats of one margin may stay pools of their own; the curve is the same.
    assert np.allclose(np.interp(x, *a), np.interp(x, *b), atol=1e-9)


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=300)
    _, y = toxicity.isotonic(x, (r.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(y) > 0).all() and y.min() >= 0 and y.max() <= 1


# --- top-k ----------------------------------------------------------------------------------------------


def vectors_of(spark, n=300, dim=16):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=dim).round(3).tolist(), int(i % 3)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None] * (dim // 2), 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("inf")] * dim, 2), (n + 4, [0.0] * dim, 1), (n + 5, [1.0, 2.0], 1), (n + 6, rows[7][1], None), (n + 7, [], 0)]
    rows += [(n + 10 + i, rows[5][1], 2) for i in range(20)] + [(n + 40 + i, (np.array(rows[6][1]) + r.normal(size=dim) * 0.05).tolist(), 0) for i in range(15)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def good(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [2048, 40])
def test_top_k(spark, block):
    rows, df = vectors_of(spark)
    ints = {i: np.floor(256 * np.array(v)) for i, v, _ in rows if good(v)}
    want = {}
    for q in ints:
        if q % 10 == 0:
            scored = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
            want |= {(q, i + 1): (c, -s) for i, (s, c) in enumerate(scored)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("most,at_once", [(1 << 15, 1024), (25, 1024), (25, 7), (1 << 15, 9)])
def test_vector_dedup(spark, monkeypatch, most, at_once):
    monkeypatch.setattr(vector_dedup, "AT_ONCE", at_once)
    rows, df = vectors_of(spark)
    ok = {i: (np.array(v), lab) for i, v, lab in rows if good(v) and any(v) and lab is not None}
    near = defaultdict(set)
    for i, (x, a) in ok.items():
        for j, (y, b) in ok.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                near[i].add(j)
    comp = reach(near, [r[0] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df, most=most).collect()}
    assert got == {i: (len(near[i]), comp[i], comp[i] == i) for i, _, _ in rows}


def reach(near, nodes):
    comp = {}
    for n in sorted(nodes):
        if n not in comp:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = n
                    todo += near[x]
    return comp


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    order = list(range(300))
    r.shuffle(order)
    edges = list(zip(order, order[1:])) + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2001), (2001, 2002), (5, 5)]
    got = {row["node"]: row["component"] for row in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in order) and all(got[1000 + i] == 1000 for i in range(200)) and got[2002] == 2000


# --- near-duplicates ---------------------------------------------------------------------------------------


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_minhash_dedup(spark, monkeypatch):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = awkward()
    for _ in range(12):  # families at all distances around the threshold
        base = [r.choice(words) for _ in range(r.randint(30, 160))]
        for _ in range(r.randint(2, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    near = defaultdict(set)
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i != j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                near[i].add(j)
    comp = reach(near, sets)
    for tile in (2048, 3):
        monkeypatch.setattr(minhash_dedup, "TILE", tile)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs_of(spark, texts)).collect()}
        assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    one = minhash_dedup.one_of_each(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in sets if comp[i] == i)


# --- mixing --------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, budget, cap):
    target, open_ = {}, set(sizes)
    left = budget * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    r = random.Random(7)
    sources = [r.choice(["hot", "hot", "hot", "b", "c", "é", None, "tiny"]) for _ in range(3000)]
    texts = [None if i % 97 == 0 else " ".join(["w"] * (1 if sources[i] == "tiny" else r.randint(1, 60))) for i in range(3000)]
    docs = docs_of(spark, texts, sources)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 3000
    sizes, taken, targets = Counter(), Counter(), {}
    for x in rows:
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        targets[x["source"]] = x["target"]
        assert 0 <= x["copies"] <= 2 and x["size"] == len((texts[x["row_id"]] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted((x["row_id"], x["copies"]) for x in rows) == sorted((x["row_id"], x["copies"]) for x in again)
    mix = Counter(x["doc_id"] for x in mixing.mix(docs).collect())
    assert mix == Counter({x["row_id"]: x["copies"] for x in rows if x["copies"]})


def test_mixing_keeps_expectations():
    r = random.Random(1)
    for p, s, q, t in ((0.3, 10, 0.6, 25), (0.5, 1, 0.5, 1), (0.9, 7, 0.2, 3)):
        ends = [mixing.pivot(p, s, q, t, r.random()) for _ in range(20000)]
        assert all(abs(a * s + b * t - (p * s + q * t)) < 1e-9 and (a in (0, 1) or b in (0, 1)) for a, b in ends)
        assert np.mean([a for a, _ in ends]) == pytest.approx(p, abs=0.02)


def test_identical_rows_mix(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 10 + [(2, "d", "en", "s", 1)], DOCS)
    taken = sum(r["size"] * r["copies"] for r in mixing.mixed(docs).collect())
    assert sum(len(r["text"].split()) for r in mixing.mix(docs).collect()) == taken


# --- pipeline and helpers ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, out = common.table(spark, DATA, "documents"), {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = now = common.cut(stage(spark, now, DATA), f"test-{name}")
        if name != "byte_bpe":
            assert now.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in out[name].select("doc_id").collect()}
    model = toxicity.train(docs, common.table(spark, DATA, "labels"))
    assert ids("toxicity") == {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    kept = minhash_dedup.near_duplicates(out["toxicity"]).where("kept")
    assert ids("minhash_dedup") == {r["doc_id"] for r in kept.collect()} and out["minhash_dedup"].count() == kept.count()
    assert all("@" not in m for r in out["pii"].collect() for m in re.findall(BASE["email"].pattern, r["text"] or ""))
    texts, codec = Counter(r["text"] for r in out["mixing"].collect()), byte_bpe.Codec(byte_bpe.ranks_path())
    assert texts == Counter(codec.decode(bytes(r["ids"])).decode() for r in out["byte_bpe"].collect())


def test_hash_of_documents(spark):
    row = registry.QUERIES["op6_byte_bpe"](spark, DATA).join(common.table(spark, DATA, "documents"), "doc_id").first()
    assert row["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_bloom_never_misses(spark):
    ids = spark.range(0, 5000, 7).toDF("id")
    bloom = common.Bloom(ids)
    spots = spark.range(5000).toDF("id").select("id", bloom.spots().alias("s")).toArrow()
    passed = bloom.passed(spots.column("s").combine_chunks())
    hit = set(np.array(spots.column("id"))[passed].tolist())
    assert set(range(0, 5000, 7)) <= hit and len(hit) < 1000


def test_discard(spark):
    df = common.cut(spark.range(5), "discard")
    path = common.WRITTEN[-1]
    assert df.count() == 5
    common.discard(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not common.WRITTEN and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)

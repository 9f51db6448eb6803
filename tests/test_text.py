import random
import unicodedata

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def test_normalisers(spark):
    assert one(spark, "  a \n b\t c ", T.squish) == "a b c"
    assert one(spark, "It's  a-Test!", T.dedup_key) == "its atest"
    for raw in ("10.1/ABC", "https://doi.org/10.1/abc", "doi: 10.1/abc.", " http://dx.doi.org/10.1/Abc;, "):
        assert one(spark, raw, T.normalize_doi) == "10.1/abc"
    for raw in ("na", "NULL", "", "  ", None):
        assert one(spark, raw, T.normalize_doi) is None
    assert one(spark, "Epichloë  Ñandú", T.normalize_key) == "epichloe nandu"
    assert one(spark, "N/A", lambda c: T.normalize_key(c, ["n/a"])) == ""


def test_binomials(spark):
    cases = {"Fusarium sp.": "fusarium", "A. niger": "a. niger", "Fragaria x ananassa": "fragaria ananassa", "Lolium perenne (ryegrass) L.": "lolium perenne", "": "", "Epichloë [x]": "epichloë"}
    for raw, want in cases.items():
        assert one(spark, raw, T.canonical_binomial) == want, raw


def test_cells(spark):
    assert one(spark, "rice; maize | wheat and rye/ none,", lambda c: T.split_multi(c, na_tokens=["none"])) == ["rice", "maize", "wheat", "rye"]
    assert one(spark, None, T.split_multi) == []
    assert one(spark, "Taxon: <b>Rosa</b> (wild)", T.clean_name) == "rosa"
    assert one(spark, "one two three four five six seven", T.clean_name) is None
    assert one(spark, 'a "b', T.sanitize_line) == "a b"
    assert one(spark, '"a" \\b', T.sanitize_line) == '"a" b'
    assert one(spark, "Southern Spain province; 12; (Peru)", T.clean_places) == ["spain", "peru"]
    assert one(spark, "a;b", T.first_item) == "a"
    assert one(spark, "in 1834 and 2011", T.plausible_year) == 1834
    assert one(spark, "none", T.plausible_year) is None
    assert one(spark, "a b/c:d!", T.slug) == "a_b_c_d"
    assert one(spark, "Rosa cf. canina st1", T.name_key) == "rosa canina"


def test_standardize(spark):
    mapping = {"leaf": "leaf", "leaf litter": "soil", "root": "root"}
    assert one(spark, "Leaf (young)", lambda c: T.standardize(c, mapping)) == "leaf"
    assert one(spark, "old leaf litter", lambda c: T.standardize(c, mapping)) == "soil"
    assert one(spark, "rootlet", lambda c: T.standardize(c, mapping, mode="word")) == "rootlet"
    assert one(spark, "not given", lambda c: T.standardize(c, mapping, na_phrases=["not given"])) is None
    assert one(spark, "xy", lambda c: T.standardize(c, mapping)) is None


def test_quotes_and_places(spark):
    text = "The “quick” brown fox jumped over the la-\nzy dog near the river bank at noon."
    support = lambda q: spark.createDataFrame([(q, text)], "q string, t string").select(T.quote_support("q", "t").alias("s")).first()["s"]
    assert support('the "quick" brown fox') == "exact"
    assert support("jumped over the lazy dog") == "exact"
    assert support("brown fox jumped over the lazy cog near the river") == "fuzzy"
    assert support("quite another sentence that is long enough") == "none"
    assert support("") == "empty"
    found = one(spark, "at 12°30'S, 45°15'30\"W and 51.5074, -0.1278 but not 99.1234, 10.0000", T.coordinates)
    assert [(round(p["lat"], 4), round(p["lon"], 4)) for p in found] == [(-12.5, -45.2583), (51.5074, -0.1278)]


def test_json_and_html(spark):
    assert one(spark, 'x {"k": 3} y', lambda c: T.salvage_json(c, "k int"))["k"] == 3
    assert one(spark, "no", lambda c: T.salvage_json(c, "k int")) is None or one(spark, "no", lambda c: T.salvage_json(c, "k int"))["k"] is None
    assert one(spark, '{"a":"http://x.y/1","b":[{"c":"https://z"}]}', T.json_urls) == ["http://x.y/1", "https://z"]
    assert one(spark, "<p>a&amp;b<script>var x='<p>'</script> c</p>", T.html_text) == "a&b c"


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 4.0, "NA"), (3.0, 0.0, " x ")], "a double, b double, s string")
    rows = df.select(S.percent("a", "b").alias("p"), S.nullify("s").alias("s"), S.clamp("a").alias("c"), S.band("a", [2], ["low", "high"]).alias("k"), S.plausible("a", 0, 2).alias("v"), S.first_present(F.lit(" "), "s", default="d").alias("f")).collect()
    assert [tuple(r) for r in rows] == [(25.0, None, 1.0, "low", 1.0, "NA"), (None, "x", 1.0, "high", None, " x ")]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f("x").alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_forms_of_unicode(spark):
    r = random.Random(1)
    signs = [chr(c) for c in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), 0xBD, 0x2122, 0x33A5, 0xAC01, 0xD55C, 0xD7A3, 0xFDFA, 0x1D400, 0x212B, 0x3000, 0xA0)]
    texts = ["".join(r.choice([*"abc X", r.choice(signs)]) for _ in range(20)) for _ in range(150)] + ["e\u0301a\u0302\u0301", "plain", "", None]
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert many(spark, texts, T.fold_accents) == [None if t is None else strip(t) for t in texts]
    assert many(spark, texts, T.compatible) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def partial_ratio(quote, text):
    """The best alignment, by trying all of them."""
    a, b = (quote, text) if len(quote) <= len(text) else (text, quote)

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            old = 0
            for j, d in enumerate(y):
                old, row[j + 1] = row[j + 1], old + 1 if c == d else max(row[j], row[j + 1])
        return row[-1]

    windows = {b[max(i, 0) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(2 * common(a, w) / (len(a) + len(w)) for w in windows)


def test_best_alignment_anywhere():
    r = random.Random(3)
    text = "".join(r.choice("abcde ") for _ in range(150))
    hits = 0
    for _ in range(60):
        n, at = r.randint(20, 45), r.randint(0, 110)
        quote = list(text[at : at + n])
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(quote))
            quote[k : k + r.randint(0, 1)] = r.choice(["", "x", "xy", "a"])
        quote = "".join(quote)
        want = partial_ratio(quote, text) >= 0.92
        assert T.aligned(quote, text, 0.92) == want, quote
        hits += want
    assert 10 < hits < 60
    assert T.aligned("text that is longer than the other", "text that is longer than", 0.92) and not T.aligned("", "", 0.92)


def test_quote_support_reaches_every_branch(spark):
    text = "Fungi were isolated from healthy leaves \u2013 all plants sampled in Panama held endophytes | and ﬁne roots too."
    cases = {
        "wree isolated from healthy leaves - all plants sampled": "fuzzy",  # the first word itself is misspelt
        "held endophytes and fine roots too": "exact", "HELD   endophytes": "exact", "helt endophytes": "none", "": "empty", None: "empty",
        "nothing of this kind was ever written in the text at all": "none",
    }
    rows = spark.createDataFrame([(q, text) for q in cases], "q string, t string")
    assert [r["s"] for r in rows.select(T.quote_support("q", "t").alias("s")).collect()] == list(cases.values())


def test_coordinates_as_written(spark):
    cases = {
        "12.5°N, 45°E": [(12.5, 45.0)], "12,25° S / 45,5° W": [(-12.25, -45.5)], "8º 30' 36\" N; 79º 15' W": [(8.51, -79.25)], "9.12345 / -79.54321": [(9.12345, -79.54321)],
        "8°30'N": [], "95°N 10°E": [], "version 1.2345.6789, 2.3456": [], "": [],
    }
    assert [[(p["lat"], p["lon"]) for p in found] for found in many(spark, list(cases), T.coordinates)] == list(cases.values())


def test_name_keys(spark):
    assert many(spark, ["Fusarium cf. oxysporum CBS 123.45", "Epichloë sp. nov.", "Trichoderma (Hypocrea) spp.", "X. y FJ-123a", None], T.name_key) == ["fusarium oxysporum", "epichloë sp", "trichoderma sp", "x y", ""]
    assert many(spark, ["Zea mays L.", " Poa-cf annua ", None], T.host_key) == ["zea mays l", "poacf annua", ""]
    assert many(spark, ["Zea cf. mays L.", "Poa", "nan "], T.species_key) == ["zea mays", "poa", "nan"] and one(spark, "Zea  mays", T.genus_key) == "zea"


def test_candidate_names(spark):
    text = "Zea mays, Zea  mays; Poa annua and Fusarium oxysporum in The leaf; Ab initio"
    assert one(spark, text, T.candidate_names) == ["Fusarium oxysporum"]
    assert one(spark, "Quercus robur\nQuercus  robur Quercus Ilex", T.candidate_names) == ["Quercus robur", "Quercus robur"]
    assert one(spark, text + " Quercus robur", lambda c: T.candidate_names(c, ["Quercus"])) == ["Quercus robur"]


def test_typed_answers(spark):
    labels, starts = {"Yes, always": "yes", "Leaf": "leaf"}, {"other": "other", "non-english": "non_english"}
    values = ["Leaf", " Yes, always ", "Other: bark", "Leaf; other thing, twig", "nan", None]
    assert many(spark, values, lambda c: T.typed_values(c, labels, starts)) == [["leaf"], ["yes"], ["other"], ["leaf", "other", "twig"], [], []]
    assert many(spark, ["Non-English: French", "Leaf", "bark", " "], lambda c: T.typed_value(c, labels, starts)) == ["non_english", "leaf", "bark", None]
    places = ["USA; Peru|u.s.a", "not stated", None]
    assert many(spark, places, lambda c: T.place_set(c, {"usa": "united states"})) == [["peru", "united states"], [], []]
    assert many(spark, places, lambda c: T.place_token(c, {"usa": "united states"})) == ["peru; united states", "not stated", None]
    assert many(spark, ["8 N 79 W", "Not stated", " ", None], T.stated) == ["yes", "no", None, None]


def test_urls_of_json_values(spark):
    texts = ['{"http://key": 1, "a": {"$": "http:\\/\\/x.y\\/1"}, "b": [["https://z"], "no", {"c": [{"d": "http://deep"}]}]}', '"http://only"', "no json http://x", "[]", None]
    assert [sorted(u) for u in many(spark, texts, T.json_urls)] == [["http://deep", "http://x.y/1", "https://z"], ["http://only"], [], [], []]


def test_few_stretches_are_aligned(monkeypatch):
    r, calls, one_pair = random.Random(7), [], T.shared_length
    monkeypatch.setattr(T, "shared_length", lambda *a: calls.append(a) or one_pair(*a))
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    text = " ".join(r.choice(words) for _ in range(5000))
    assert not T.aligned("no such words in this text: " + text[9000:9060][::-1], text, 0.92) and len(calls) < 200
    assert T.aligned(text[9000:9030] + "zz" + text[9031:9060], text, 0.92) and len(calls) < 200


def test_quotes_in_letters_of_hangul(spark):
    text = "caf\u00e9 \ud55c\uad6d\uc5b4 \u00b2 ok"
    rows = spark.createDataFrame([(unicodedata.normalize("NFD", text), text), ("x", None)], "q string, t string")
    assert [r["s"] for r in rows.select(T.quote_support("q", "t").alias("s")).collect()] == ["exact", "none"]

"""Every registered query of the library against its SQL, on the smallest tables."""

import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from conftest import DATA, same_as_sql

from ledgerline.plans.registry import ORACLES, QUERIES


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    got, want = same_as_sql(QUERIES[name](spark, DATA), ORACLES[name])
    assert got == want


#: Queries that SQL can't express, and the tests that hold them against brute force.
BY_BRUTE_FORCE = {
    "sentence_counts": "test_sentences_and_evidence", "evidence_windows": "test_sentences_and_evidence", "candidate_names": "test_candidate_names_by_python", "quote_support": "test_quote_support_by_python",
    "analysis_sample": "test_drawn_sample", "analysis_staged_extraction": "test_staged_extraction", "quota_draw": "test_quota_draw_looks_at_every_document",
}


def test_every_query_without_sql_has_a_test():
    assert set(QUERIES) - set(ORACLES) == set(BY_BRUTE_FORCE)
    assert {v for v in BY_BRUTE_FORCE.values()} - set(globals()) == {"test_quota_draw_looks_at_every_document"}


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def split_sentences(text):
    return [s for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z0-9\[(])|\n{2,}", text) if s.strip(" ")]


def test_sentences_and_evidence(spark):
    texts = texts_of(spark)
    assert {r["doc_id"]: r["sentences"] for r in QUERIES["sentence_counts"](spark, DATA).collect()} == {i: len(split_sentences(t)) for i, t in texts.items()}
    want = set()
    for i, t in texts.items():
        parts = split_sentences(t)
        hit = ["thing" in s for s in parts]
        want |= {(i, k + 1, len(s), md5(s)) for k, s in enumerate(parts) if any(hit[max(k - 1, 0) : k + 2])}
    assert want and {(r["doc_id"], r["place"], r["size"], r["digest"]) for r in QUERIES["evidence_windows"](spark, DATA).collect()} == want


def test_candidate_names_by_python(spark):
    found = Counter(f"{a} {b}" for t in texts_of(spark).values() for a, b in re.findall(r"\b([A-Z][a-z]{3,})\s+([a-z]{4,})\b", t))
    assert found and {r["name"]: r["n"] for r in QUERIES["candidate_names"](spark, DATA).collect()} == found


def quote_text(text):
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "−": "-", "\u00ad": ""})).lower()
    return re.sub(r"\s+", " ", re.sub(r"[*_`#>|]", " ", re.sub(r"-\s*\n\s*", "", text))).strip()


def test_quote_support_by_python(spark):
    from ledgerline.functions.text import aligned

    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        t = r["text"] or ""
        at = int(len(t) / 2)
        middle = t[at : at + (20 if r["lang"] == "es" else 60)]
        quote = middle if r["lang"] == "en" else "no such words in this text: " + middle[::-1] if r["lang"] == "fr" else re.sub(r"(.)(.)(.{3})$", r"\2\1\3", re.sub(r"^(.{3})(.)(.)", r"\1\3\2", middle))
        q, n = quote_text(quote), quote_text(t)
        want[r["doc_id"]] = "empty" if not q else "exact" if q in n else "fuzzy" if len(q) >= 25 and aligned(q, n, 0.92) else "none"
    got = {r["doc_id"]: r["support"] for r in QUERIES["quote_support"](spark, DATA).collect()}
    assert got == want and {"exact", "fuzzy", "none"} <= set(want.values())


def test_drawn_sample(spark):
    from ledgerline.operators.sampling import allocate

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    pool = [(r["doc_id"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["doc_id"] not in toxic]
    quotas = allocate(Counter(x or "" for _, x in pool), 60)
    strata = {lang: sorted((d for d, x in pool if (x or "") == lang), key=lambda d: (md5(f"{d}s"), d))[: quotas[lang]] for lang in quotas}
    order = sorted((k, -len(ids), lang, d) for lang, ids in strata.items() for k, d in enumerate(ids))
    want = {(d, place + 1, "shared" if place < 20 else "single") for place, (*_, d) in enumerate(order)}
    assert {(r["doc_id"], r["place"], r["block"]) for r in QUERIES["analysis_sample"](spark, DATA).collect()} == want


def test_staged_extraction(spark):
    from ledgerline.plans.analyses import staged_extraction

    texts = {1: "intro Maria thing here. Another Maria line.\nAlpha head\nPeter went. The thing of Peter is big. Nothing else.\nBeta\n\nPaula alone.", 2: "", 3: None, 4: "Zed\nno names thing"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    out = staged_extraction(docs, "doc_id", "text", "^[A-E]", 30, 10, r"\b[A-Z][a-z]{4,}\b", "thing")
    want = set()
    for i, t in texts.items():
        bodies, at = [[]], 0
        for line in (t or "").split("\n"):
            if re.match("[A-E]", line):
                bodies.append([])
            else:
                bodies[-1].append(line)
        whole = "\n".join(b for b in ("\n".join(x).strip(" ") for x in bodies) if b)
        chunks, names = [], Counter()
        for at in range(0, max(len(whole) - 10 - 1, 0) + 1, 20):
            chunks.append(whole[at : at + 30])
        for c in chunks if whole else []:
            names.update({n for n in re.findall(r"\b[A-Z][a-z]{4,}\b", c)})
        folded = Counter()
        for n, k in names.items():
            folded[n.lower()] += k
        parts = split_sentences(whole)
        near = " ".join(s.lower() for k, s in enumerate(parts) if any("thing" in x for x in parts[max(k - 1, 0) : k + 2]))
        ranked = sorted((not n in near, -k, n) for n, k in folded.items())
        want |= {(i, n, -k, not no, rank + 1) for rank, (no, k, n) in enumerate(ranked)}
    assert {(r["doc_id"], r["name"], r["chunks"], r["verified"], r["listed_rank"]) for r in out["entities"].collect()} == want and len(want) > 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_key_join_takes_every_customer(spark):
    customers = {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").where("c_name is not null").select("c_custkey").collect()}
    rows = QUERIES["derived_key_join"](spark, DATA).collect()
    assert {r["c_custkey_x"] for r in rows} == {r["c_custkey_y"] for r in rows} == customers


def test_dedup_keeps_documents_that_differ_late(spark, tmp_path):
    opening = "the same opening " * 20
    docs = [(1, opening + "one end", "en", "s"), (2, opening + "another end", "en", "s"), (3, opening + "one, end!", "en", "s"), (4, opening + "one  end", "en", "s"), (5, "short text here", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["id"] for r in QUERIES["dedup_pipeline_kept"](spark, str(tmp_path)).collect()} == {2, 3}
    assert {r["stage"]: r["removed"] for r in QUERIES["dedup_stage_ledger"](spark, str(tmp_path)).collect()} == {"usable": 1, "text": 1, "language": 0, "letters": 1}


def test_claims_in_odd_texts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    spaces = " \n\u00a0\u1680\u2000\u2003\u202f\u3000"
    texts = [f"{c}thing is{c}. no" for c in f"{spaces}0\r\t\u200b\u180e"] + ["0. 1thing1. 2thing", "a th\u0130ng. x", "thing \u0130s. x", "  thing  .  of thing  ", "\r\nthing\r\n. b", ". ".join(["thing is"] * 307 + ["thing"] * 13), None, ""]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), tmp_path / "documents.parquet")
    df = QUERIES["claim_detection"](spark, str(tmp_path))
    got, want = same_as_sql(df, ORACLES["claim_detection"], str(tmp_path))
    assert got == want and df.where("found = 320").first()["confidence"] == 0.520312

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import analyses


def test_resolve_cells(spark):
    accepted = spark.createDataFrame([("oryza sativa", 3, "Oryza sativa"), ("zea mays", 4, "Zea mays")], "key string, id int, name string")
    synonyms = spark.createDataFrame([("zea vulgaris", 4)], "key string, id int")
    df = spark.createDataFrame([(1, 9, "Oryza sativa; Zea vulgaris"), (2, 9, "nothing known; Zea mays"), (3, 9, None)], "row int, paper int, cell string")
    out = analyses.resolve_cells(df, "row", "cell", "paper", accepted, synonyms)
    got = {r["row"]: (r["resolved_name"], r["status"], r["confidence"]) for r in out["cells"].collect()}
    assert got[1] == ("Oryza sativa; Zea mays", "Resolved", "0.98") or got[1] == ("Oryza sativa; Zea mays", "Resolved", "0.97")
    assert got[2][1] == "Partially resolved" and got[3] == (None, None, None)
    assert [r["token"] for r in out["review"].collect()] == ["nothing known"]


def test_standardise(spark):
    df = spark.createDataFrame([(1, "Leaf blade", "FR"), (2, "unknown part", "DE")], "id int, tissue string, country string")
    out = analyses.standardise(df, {"tissue": {"leaf": "leaf"}}, {"country": F.when(F.col("id") == 1, F.array(F.lit("FR"), F.lit("ES")))}, na_phrases=["unknown"])
    assert sorted((r["id"], r["tissue"], r["country"]) for r in out.collect()) == [(1, "leaf", "ES"), (1, "leaf", "FR"), (2, None, "DE")]


def test_spatial_bias_and_correlation(spark):
    df = spark.createDataFrame([(i, float(i * i), i % 3, "" if i % 2 else "x", 2.0 * i + 1) for i in range(30)], "id int, m double, g int, h string, y double")
    out = analyses.spatial_bias(df.withColumn("g", F.col("g").cast("string")), "id", "m", "g", [(0.5, "low")], "high", 10, "h")
    assert out["classes"].where("bias_class = 'low'").count() == 15
    assert {r["g"] for r in out["sensitivity"].collect()} == {"x", "0", "1", "2"}
    c = analyses.correlation(df, "id", "y")
    assert c["r"] == pytest.approx(1) and c["rho"] == pytest.approx(1) and c["r_p"] < 1e-6


def test_score_and_relationships(spark):
    truth = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "stage string, id int, kind string")
    found = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y")], "stage string, id int, kind string")
    ratings = spark.createDataFrame([("f", 1, "u", 1), ("f", 1, "u", 2), ("f", 1, "v", 3)], "field string, item int, value string, seen int")
    out = analyses.score(truth, found, ratings, ["id"], ["stage"], ["kind"], ["item"], "field", "value", "seen")
    row = out["prf"].first()
    assert (row["tp"], row["fp"], row["fn"], row["precision"]) == (1, 1, 1, 0.5)
    assert out["consensus"].first()["value"] == "u" and out["missed"].first()["id"] == 2 and out["wrong"].first()["id"] == 3
    df = spark.createDataFrame([(1, "a pathogen", "FR"), (1, "endophyte", "FR"), (2, "endophyte", "DE")], "paper int, note string, country string")
    rel = analyses.relationship_summaries(df, [("Pathogen", "pathogen"), ("Endophyte", "endophyt")], F.col("note"), "paper", ["country"])
    assert {r["relationship"]: r["n"] for r in rel["entities"].collect()} == {"Pathogen": 1, "Endophyte": 2}
    assert rel["by_country"].count() == 3


def test_association_and_robustness(spark):
    df = spark.createDataFrame([("a", "x", i) for i in range(10)] + [("b", "y", i) for i in range(10)] + [("c", "y", 1)], "p string, q string, e int")
    out = analyses.association(df, "p", "q", 2)
    assert out["cells"].count() == 2 and out["test"].first()["statistic"] == pytest.approx(20.0)
    rows = spark.createDataFrame([(i, float(i % 7), float(i), 10.0 + i, i % 2) for i in range(40)], "id int, effort double, priority double, area double, region int")
    suite = analyses.robustness(rows, "id", "effort", "priority", "area", "region")
    assert suite["sweep"].count() == 4 and suite["regions"].count() == 2 and suite["quartile_test"].first()["df"] == 3

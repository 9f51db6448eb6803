import json

from pyspark.sql import functions as F

from ledgerline.sources import readers, writers
from ledgerline.streaming import incremental


def test_union_scan_and_shards(spark, tmp_path):
    (tmp_path / "s1.csv").write_text('id,a\n1,"x, y"\n2,"line\nbreak"\n')
    (tmp_path / "s2.csv").write_text("id,b\n2,z\n3,w\n")
    df = readers.union_scan(spark, f"{tmp_path}/s*.csv", source="file")
    assert sorted(df.columns) == ["a", "b", "file", "id"] and df.count() == 4
    assert readers.shards(spark, f"{tmp_path}/s*.csv", ["id"], ["shard"]).count() == 3
    assert readers.first_path(spark, [f"{tmp_path}/none.csv", f"{tmp_path}/s2.csv"]).endswith("s2.csv")


def test_preamble_lines_and_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("about\nmore\nid,name\n1,a\n2,b\n")
    assert [tuple(r) for r in readers.after_preamble(spark, f"{tmp_path}/p.csv", 2).orderBy("id").collect()] == [("1", "a"), ("2", "b")]
    assert [r["line"] for r in readers.lines(spark, f"{tmp_path}/p.csv").orderBy("line_no").collect()][:3] == ["about", "more", "id,name"]
    assert readers.pick_column(["Source.Title", "DOI"], ["doi"]) == "DOI"
    assert readers.pick_column(["Source.Title"], ["source title"]) == "Source.Title"
    assert readers.find_columns(["Host plant name", "x"], {"host": ["host", "name"]}) == {"host": "Host plant name"}
    # Body lines that say the same as the preamble or the header stay, quoted separators don't split names.
    (tmp_path / "q.csv").write_text('1,2\nabout\n"id, no",name\n1,2\nabout\n"id, no",name\n"x, y",3\n')
    again = readers.after_preamble(spark, f"{tmp_path}/q.csv", 2)
    assert again.columns == ["id, no", "name"]
    assert sorted((r[0], r[1]) for r in again.collect()) == [("1", "2"), ("about", None), ("id, no", "name"), ("x, y", "3")]
    text = readers.binary_documents(spark, f"{tmp_path}/p.csv", lambda b: b.decode()[:5]).first()
    assert text["text"] == "about"


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 5)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.lines(spark, f"{tmp_path}/*.txt")
        assert got.select("line").rdd.getNumPartitions() > 3
        rows = [(r["file"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(rows) == sorted((f, i, f"{f} line {i}") for f, n in (("a.txt", 3000), ("b.txt", 5)) for i in range(n))


def test_documents_by_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9".encode("latin-1"))
    (tmp_path / "b.MD").write_bytes(b"\xef\xbb\xbf# caf\xc3\xa9")
    (tmp_path / "c.html").write_text("<p>a&amp;b</p><script>x</script>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF one")
    (tmp_path / "e.pdf").write_bytes(b"broken")
    (tmp_path / "f.bin").write_bytes(b"\x00")
    (tmp_path / "g.txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "h.txt").write_bytes(b" ")

    def pdf(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no pdf")
        return content[5:].decode()

    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["status"]) for r in readers.documents(spark, f"{tmp_path}/*", {"pdf": pdf}).collect()}
    assert got == {"a.txt": ("caf\u00e9", "ok"), "b.MD": ("# caf\u00e9", "ok"), "c.html": ("a&b", "ok"), "d.pdf": ("one", "ok"), "e.pdf": (None, "failed"), "f.bin": (None, "unread"), "g.txt": ("wide", "ok"), "h.txt": (" ", "empty")}


def workbook(path, sheets):
    """A workbook of shared, inline and plain cells, with gaps."""
    from zipfile import ZipFile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>DOI</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_sheets_of_a_workbook(spark, tmp_path):
    body = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Note</t></is></c></row>'
        '<row r="3"><c r="A3"><v>10.5</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="s"><v>1</v></c></row><row r="4"><c r="C4" t="str"><v> </v></c></row>'
    )
    workbook(tmp_path / "w.xlsx", {"Other": "", "Review": body})
    df = readers.sheet(spark, f"{tmp_path}/w.xlsx", "Review")
    assert df.columns == ["DOI", "column_2", "Note"] and [tuple(r) for r in df.collect()] == [("10.5", "true", "rich")]
    assert readers.sheet(spark, f"{tmp_path}/w.xlsx").columns == []


def test_attributes_of_features(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"coordinates": [1, 2]}, "properties": {"iso": "PER", "name": "Peru", "n": 3}}, {"type": "Feature", "properties": {"iso": "FRA"}}]
    (tmp_path / "w.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    assert [tuple(r) for r in readers.feature_attributes(spark, f"{tmp_path}/w.geojson", ["iso", "name", "n"]).collect()] == [("PER", "Peru", "3"), ("FRA", None, None)]


def test_paged_sources(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def fetch(key, page):
        """Three pages a key; the second answers at the second try."""
        n = page or 0
        tried = log / f"{key}-{n}"
        if n == 1 and not tried.exists():
            tried.touch()
            raise OSError("busy")
        return [(key, n, f"v{key}{n}")], n + 1 if n < 2 else None

    got = readers.pages(fetch, "k long, page int, v string", spark.range(3).toDF("k"), "k", wait=0.01)
    assert sorted(tuple(r) for r in got.collect()) == [(k, n, f"v{k}{n}") for k in range(3) for n in range(3)]
    import pytest

    with pytest.raises(Exception, match="never"):
        readers.pages(lambda k, p: (_ for _ in ()).throw(OSError("never")), "k long", spark.range(1).toDF("k"), "k", retries=1, wait=0.01).collect()


def test_config_cache_and_pages(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": [1]}))
    assert readers.config(spark, f"{tmp_path}/c.json") == {"a": [1]}
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for version in ("v1", "v1", "v2"):
        assert readers.memoised(spark, f"{tmp_path}/memo", version, make).count() == 3
    assert len(made) == 2
    got = readers.pages(lambda k, page: ([(k, k * 10)], None), "k long, v long", spark.range(4).toDF("k"), "k")
    assert sorted(tuple(r) for r in got.collect()) == [(k, k * 10) for k in range(4)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("reason", F.when(F.col("id") < 3, "low"))
    writers.write_kept_and_rejected(df, "reason", f"{tmp_path}/kept", f"{tmp_path}/rejected")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(3, 10))
    assert sorted((r["id"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/rejected").collect()) == [(i, "low") for i in range(3)]
    writers.write_csv(df.withColumn("l", F.array(F.lit("a"))), f"{tmp_path}/csv", one_file=True, quote_all=True)
    assert readers.csv(spark, f"{tmp_path}/csv").count() == 10
    writers.write_twin(df, f"{tmp_path}/twin", "reason is not null")
    assert readers.jsonl(spark, f"{tmp_path}/twin/jsonl").count() == 10
    assert writers.manifest(df, f"{tmp_path}/manifest", {"seed": 1})["rows"] == 10
    report = writers.qa_report({"rows_in": 3, "kept": 2, "rejected": 1}, {"a": 60.0}, 0)
    assert report["status"] == "PASS_WITH_WARNINGS"
    assert writers.qa_report({}, {}, 2)["status"] == "FAIL"
    writers.write_report(df.limit(2), f"{tmp_path}/report", "Rows")
    assert "| id | reason |" in spark.read.text(f"{tmp_path}/report").collect()[2][0]
    writers.write_report(df, f"{tmp_path}/long", "Rows", most=4)
    text = [r[0] for r in spark.read.text(f"{tmp_path}/long").collect()]
    assert "6 more rows are not shown." in text and sum(x.startswith("| ") for x in text) == 5


def test_ingest_goes_on_where_it_ended(spark, tmp_path):
    source, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    spark.range(5).toDF("id").write.parquet(source)
    incremental.ingest(spark, source, "id long", sink, check, ["id"])
    spark.range(3, 9).toDF("id").write.mode("append").parquet(source)
    for _ in range(2):
        incremental.ingest(spark, source, "id long", sink, check, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(9))


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:03:00", "a", 2.0), ("2024-01-01 00:20:00", "a", 5.0)], "ts string, k string, v double").select(F.to_timestamp("ts").alias("ts"), "k", "v")
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    query = incremental.windowed(stream, "ts", ["k"], "v").writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["n"], r["total"]) for r in spark.sql("select * from windows").collect()] == [(2, 3.0)]

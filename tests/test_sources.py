import io
import zipfile

from pyspark.sql import functions as F

from vellumine.operators import hooks
from vellumine.sources import archive, sinks
from vellumine.streaming import flows


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    p = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p>'
    t = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(p + t))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.epub").write_bytes(sinks.epub_bytes("Book", [("One", "first\n\nsecond"), ("Two", "third")]))
    (tmp_path / "d.html").write_text("<h2>H</h2><p>x <i>y</i></p><pre>a\n  b</pre>")
    (tmp_path / "e.md").write_text("# as it is\n")
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../x", "y")
    (tmp_path / "f.docx").write_bytes(evil.getvalue())
    got = {r.path.rsplit("/", 1)[-1]: (r.markdown, r.error) for r in archive.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "# Title\n\n**bold** text\n\n| a | b |\n|---|---|"
    assert got["b.docx"][0] is None and "not an archive" in got["b.docx"][1] and "unsafe path" in got["f.docx"][1]
    assert got["c.epub"][0] == "# One\n\nfirst\n\nsecond\n\n# Two\n\nthird"
    assert got["d.html"][0] == "## H\n\nx *y*\n\n```\na\n  b\n```" and got["e.md"][0] == "# as it is\n"
    chapters = archive.read_chapters(spark, str(tmp_path)).orderBy("chapter_no").collect()
    assert [(r.chapter_no, r.member) for r in chapters] == [(0, "c0.xhtml"), (1, "c1.xhtml")]
    assert archive.epub_parts((tmp_path / "c.epub").read_bytes())[1] == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "# A\n\nx\n# B\n\ny"), (2, "no heading"), (3, ""), (4, None)], "id bigint, t string")
    assert sinks.export_chapters(df, "id", "t", str(tmp_path / "ch")).count() == 0
    for _ in range(2):
        out = sinks.put_artifacts(df.where("t <> ''"), "t", str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2 and out.columns == ["id", "digest"]
    sinks.prune_artifacts(spark, str(tmp_path / "art"), out.where("id = 1"), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1
    books = spark.createDataFrame([("k", "T", [("a", "b")])], "key string, title string, parts array<struct<title: string, text: string>>")
    assert archive.archive_error(bytes(sinks.build_epubs(books).first().epub)) is None


def test_cache_computes_once(spark, tmp_path):
    seen = []

    def compute(need):
        seen.append(need.count())
        return need.select("digest", F.upper("payload").alias("result"))

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, t string")
    for _ in range(2):
        got = sorted(tuple(r) for r in sinks.cached(df, "id", "t", str(tmp_path / "c"), compute).collect())
    assert got == [(1, "A"), (2, "A"), (3, "B")] and seen == [2, 0]


def test_hooks(spark):
    def hook(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "skip"), (4, None), (5, "long")], "id bigint, t string")
    got = {r.id: (r.result, r.error) for r in hooks.apply_hook(df, "id", "t", hook, F.col("t") != "skip", lambda a, b: len(b) < 4).collect()}
    assert got == {1: ("A", None), 2: ("bad", "ValueError: no"), 3: ("skip", None), 4: (None, None), 5: ("long", "rejected")}


def test_protection(spark):
    df = spark.createDataFrame([("pay 5 and 12 now",), ("none",), ("7",)], "t string")
    m, v = hooks.protect(F.col("t"), "[0-9]+")
    out = df.select("t", m.alias("m"), v.alias("v")).select("t", "m", hooks.restore(F.col("m"), F.col("v")).alias("back"), hooks.restore(F.regexp_replace("m", "1", ""), F.col("v")).alias("lost")).collect()
    assert all(r.t == r.back for r in out) and not any(c.isdigit() and "" not in r.m for r in out for c in r.m)
    assert [r.lost for r in out] == [None, "none", "7"]


def test_local_images(spark):
    df = spark.createDataFrame([(1, "![a](x.png) ![b](<y z.png>) ![c](http://h/i.png)")], "id bigint, t string")
    known = spark.createDataFrame([("x.png",)], "path string")
    assert sorted((r.target, r.present) for r in archive.local_images(df, "id", "t", known).collect()) == [("x.png", True), ("y z.png", False)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "job_id string, sequence bigint, to_status string, ts timestamp"
    rows = lambda x: spark.createDataFrame(x, "job_id string, sequence bigint, to_status string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows([("a", 1, "ready", "2024-01-01 00:00:00"), ("a", 2, "running", "2024-01-01 00:10:00"), ("b", 1, "ready", "2024-01-01 01:00:00"), (None, 1, "x", "2024-01-01 00:00:00")]).coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema(schema).parquet(str(src))
    q = flows.snapshot_sink(read(), "job_id", "sequence", ["to_status"], str(tmp_path / "snap"), str(tmp_path / "cp"), "0 seconds", every=2)
    f = flows.state_fold(read(), {("ready", "running")}).writeStream.outputMode("update").format("memory").queryName("folds").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    f.processAllAvailable()
    rows([("a", 3, "ready", "2024-01-01 02:00:00"), ("c", 1, "ready", "2024-01-01 02:00:00")]).coalesce(1).write.mode("append").parquet(str(src))
    q.processAllAvailable()
    f.processAllAvailable()
    q.stop()
    f.stop()
    snap = str(tmp_path / "snap")
    rows_now = lambda: sorted((r.job_id, r.sequence) for r in flows.read_snapshot(spark, snap, "job_id", "sequence").collect())
    assert rows_now() == [("a", 3), ("b", 1), ("c", 1)]
    assert len(list((tmp_path / "snap" / "base").iterdir())) == 1 and flows.drop_merged(spark, snap) == 2
    assert rows_now() == [("a", 3), ("b", 1), ("c", 1)]
    folds = {(r.job_id, r.events): (r.state, r.illegal) for r in spark.sql("select * from folds").collect()}
    assert folds["a", 3] == ("ready", 1) and folds["a", 2] == ("running", 0)
    w = flows.windowed_counts(flows.once(read(), ["job_id", "sequence"], "ts", "1 hour"), "ts", "to_status", "1 hour", None)
    s = w.writeStream.outputMode("append").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    s.awaitTermination(60)
    assert sorted((r.to_status, r.n) for r in spark.sql("select * from wins").collect()) == [("ready", 1), ("running", 1), ("x", 1)]


def test_late_events_do_not_set_a_state_back(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    schema = "job_id string, sequence bigint, to_status string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    put([("a", 1, "ready"), ("a", 3, "done")])
    f = flows.state_fold(spark.readStream.schema(schema).parquet(str(src)), {("ready", "running"), ("running", "done")})
    q = f.writeStream.outputMode("update").format("memory").queryName("late_folds").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put([("a", 2, "running"), ("a", 4, "ready")])
    q.processAllAvailable()
    q.stop()
    last = max(spark.sql("select * from late_folds").collect(), key=lambda r: r.events)
    assert (last.state, last.events, last.illegal, last.late) == ("ready", 4, 2, 1)


def test_epub_navigation_and_metadata(spark):
    data = sinks.epub_bytes("The Map", [("One", "a\n\nb"), ("Two", "c")])
    meta, nav = archive.epub_metadata(data), archive.epub_navigation(data)
    assert meta["title"] == ["The Map"] and nav == [(0, "One", "c0.xhtml", ""), (0, "Two", "c1.xhtml", "")]
    ncx = io.BytesIO()
    with zipfile.ZipFile(ncx, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        z.writestr("OEBPS/b.opf", '<package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>A. Weiss</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="x" href="c1.xhtml"/><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n"><itemref idref="x"/></spine></package>')
        z.writestr("OEBPS/c1.xhtml", "<html><body><h1>A</h1></body></html>")
        z.writestr("OEBPS/toc.ncx", '<ncx><navMap><navPoint playOrder="1"><navLabel><text> Part </text></navLabel><content src="c1.xhtml#a"/><navPoint><navLabel><text>Inner</text></navLabel><content src="c1.xhtml#b"/></navPoint></navPoint></navMap></ncx>')
    assert archive.epub_navigation(ncx.getvalue()) == [(0, "Part", "OEBPS/c1.xhtml", "a"), (1, "Inner", "OEBPS/c1.xhtml", "b")]
    assert archive.epub_metadata(ncx.getvalue()) == {"creator": ["A. Weiss"], "language": ["en"]}

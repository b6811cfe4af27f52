import pytest

from vellumine.operators import blocks as B


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "# One\n\ntext a\nmore\n\n```\ncode\n\n# no heading\n```\n\ntext a\n\n## Two\n\ntext b"), (2, "intro\n\n# A\n\nx\n\n## A1\n\ny\n\n# B\n\nz"), (3, ""), (4, None), (5, "```\nopen\n\nfence"),
        (6, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n| no | divider |"), (7, "same\r\n\r\nsame\r\n\r\nsame"), (8, "<!-- page 4 -->\nfour\n<!-- page 5 -->\nfive\nmore"),
    ]
    return spark.createDataFrame(rows, "id bigint, t string")


def of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_blocks(docs):
    b = of(B.explode_blocks(docs, "id", "t"), "id", "position", "block")
    assert [x for x in b if x[0] == 1] == [(1, 0, "# One"), (1, 1, "text a\nmore"), (1, 2, "```\ncode\n\n# no heading\n```"), (1, 3, "text a"), (1, 4, "## Two"), (1, 5, "text b")]
    assert [x for x in b if x[0] == 5] == [(5, 0, "```\nopen\n\nfence")]
    assert {x[0] for x in b}.isdisjoint({3, 4})


def test_ids_survive_insertion(spark):
    a = B.with_ids(B.explode_blocks(spark.createDataFrame([(1, "p\n\nq\n\np")], "id bigint, t string"), "id", "t"), "id")
    b = B.with_ids(B.explode_blocks(spark.createDataFrame([(1, "new\n\np\n\nq\n\np")], "id bigint, t string"), "id", "t"), "id")
    ids = lambda df: [r.block_id for r in df.orderBy("position").collect()]
    assert ids(a) == ids(b)[1:] and len(set(ids(a))) == 3
    assert [r.ordinal for r in a.orderBy("position").collect()] == [0, 0, 1]


def test_roles(spark):
    rows = [("<!-- page 1 -->", "provenance"), ("```\nx\n```", "code"), ("![a](b.png)", "image"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("Note: x", "note"), ("## h", "heading"), ("1. x", "list"), ("> q", "quote"), ("words", "body")]
    df = spark.createDataFrame(rows, "b string, r string")
    assert df.where(B.role(df.b) != df.r).count() == 0


def test_headings_outline_chapters(docs):
    h = B.headings(docs, "id", "t")
    assert of(h.where("id = 2"), "heading_no", "level", "title") == [(0, 1, "A"), (1, 2, "A1"), (2, 1, "B")]
    assert of(h.where("id = 1"), "title") == [("One",), ("Two",)]
    assert [(r.heading_no, r.parent_no) for r in B.outline(h, "id").where("id = 2").orderBy("heading_no").collect()] == [(0, None), (1, 0), (2, None)]
    c = B.chapters(docs, "id", "t")
    assert of(c.where("id = 2"), "chapter_no", "chapter") == [(0, "intro\n"), (1, "# A\n\nx\n\n## A1\n\ny\n"), (2, "# B\n\nz")]
    assert of(c.where("id = 1"), "chapter_no") == [(0,)]


def test_tables_pages(docs):
    assert of(B.tables(docs, "id", "t"), "id", "rows", "columns") == [(6, 3, 2)]
    assert of(B.page_fill(docs, "id", "t").where("id = 8 and line_no in (1, 4)"), "line_no", "page") == [(1, 4), (4, 5)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["a" * 40] * 7 + ["b" * 300] + ["c" * 10]))], "id bigint, t string")
    b = B.explode_blocks(df, "id", "t")
    p = B.plan_chunks(b, "id", 100).join(b, ["id", "position"]).orderBy("position").collect()
    assert [r.chunk_no for r in p] == [0, 0, 1, 1, 2, 2, 3, 4, 5]


def test_ledger_findings(docs):
    e = B.ledger(docs, "id", "t")
    worse = e.withColumn("headings", e.headings - 1)
    f = B.ledger_findings(e, worse, "id", ("headings", "images"))
    assert {r.id for r in f.where("field = 'headings'").collect()} == {r.id for r in e.collect()}
    assert f.where("field = 'images'").count() == 0 and B.ledger_findings(worse, e, "id", ("headings",)).count() == 0

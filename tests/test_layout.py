import random

from pyspark.sql import functions as F

from vellumine.operators import layout as L

SCHEMA = "doc_id bigint, page int, line_no int, page_width double, page_height double, text string, x0 double, x1 double, top double, bottom double, font_size double, bold boolean"


def line(page, no, text, x0=50.0, x1=300.0, top=400.0, size=10.0):
    return (1, page, no, 600.0, 800.0, text, x0, x1, top, top + size, size, False)


def test_sizes(spark):
    rows = [line(1, i, "body text " * 8) for i in range(5)] + [line(1, 9, "Big", size=20.0), line(1, 10, "Middle", size=14.0), line(1, 11, "Near", size=11.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert L.body_size(df).first().body == 10.0
    assert sorted((r.size, r.level) for r in L.heading_sizes(df).collect()) == [(14.0, 2), (20.0, 1)]


def test_margins_and_folios(spark):
    rows = []
    for p in range(1, 5):
        rows += [line(p, 0, "The Old Catalogue", top=20.0), line(p, 1, f"text {p}"), line(p, 2, {4: "1O4"}.get(p, str(100 + p)), top=780.0)]
    rows += [line(1, 3, "twice", top=30.0), line(2, 3, "twice", top=30.0), line(3, 3, "7", top=790.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.key for r in L.margin_lines(df).collect()} == {"the old catalogue"}
    assert sorted((r.page, r.folio) for r in L.folios(df).collect()) == [(1, 101), (2, 102), (3, 103), (4, 104)]


def test_box_pairs_against_brute_force(spark):
    random.seed(3)
    box = lambda i: (1, i, *(lambda x, y, w, h: (x, x + w, y, y + h))(random.uniform(-100, 500), random.uniform(0, 500), random.uniform(1, 200), random.uniform(1, 90)))
    a, b = [box(i) for i in range(60)], [box(i) for i in range(60)]
    s = "page int, id int, x0 double, x1 double, top double, bottom double"
    got = sorted((r.l_id, r.r_id) for r in L.box_pairs(spark.createDataFrame(a, s), spark.createDataFrame(b, s), ["page"]).collect())
    want = sorted((p[1], q[1]) for p in a for q in b if min(p[3], q[3]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[4], q[4]))
    assert got == want and got


def test_reading_order(spark):
    rows = [line(1, 0, "title", 50.0, 550.0, 10.0)]
    for i in range(4):
        rows += [line(1, 10 + i, "right", 320.0, 560.0, 50.0 + 20 * i), line(1, 20 + i, "left", 40.0, 280.0, 50.0 + 20 * i)]
    rows.append(line(1, 99, "foot", 50.0, 550.0, 700.0))
    got = [r.line_no for r in L.reading_order(spark.createDataFrame(rows, SCHEMA)).orderBy("order_no").collect()]
    assert got == [0, 20, 21, 22, 23, 10, 11, 12, 13, 99]


def test_paragraphs(spark):
    rows = [line(1, 0, "The libra-", top=100.0), line(1, 1, "rian came.", top=111.0), line(1, 2, "New one", x0=70.0, top=122.0), line(1, 3, "far away", top=200.0), line(1, 4, " ", top=211.0)]
    got = [r.text for r in L.paragraphs(spark.createDataFrame(rows, SCHEMA)).orderBy("paragraph_no").collect()]
    assert got == ["The librarian came.", "New one", "far away"]


def test_tables(spark):
    rows = [([["a", "b"], ["1", None]], "| a | b |\n|---|---|\n| 1 |  |"), ([["a"], ["x\ny"]], "<table><tr><td>a</td></tr><tr><td>x\ny</td></tr></table>"), ([["a|b"]], "| a\\|b |\n|---|")]
    df = spark.createDataFrame(rows, "r array<array<string>>, want string")
    assert [r.y == r.want for r in df.select(L.render_table(F.col("r")).alias("y"), "want").collect()] == [True] * 3


def test_characters_pages_ocr(spark):
    s = "doc_id bigint, page int, line_no int, char_no int, text string, font string, x0 double, x1 double, top double, bottom double, size double, upright boolean"
    c = [(1, 1, 0, 0, "a", "F", 10.0, 15.0, 10.0, 20.0, 10.0, True), (1, 1, 0, 1, "a", "F", 10.1, 15.1, 10.0, 20.0, 10.0, True), (1, 1, 0, 2, "b", "F", 10.1, 15.1, 10.0, 20.0, 10.0, True)]
    assert sorted(r.char_no for r in L.dedupe_characters(spark.createDataFrame(c, s)).collect()) == [0, 2]
    p = spark.createDataFrame([(1, i, 100 + (i * 37) % 50) for i in range(1, 30)] + [(2, 1, 5)], "doc_id bigint, page int, letters int")
    got = {d: sorted(r.page for r in L.page_sample(p).where(F.col("doc_id") == d).collect()) for d in (1, 2)}
    assert len(got[1]) == 5 and {1, 29} <= set(got[1]) and got[2] == [1]
    o = spark.createDataFrame([(1, 1, "A clean and readable page of text that stands by itself and is long enough to be trusted.", None), (1, 2, "", 0.9), (1, 3, "� � x $a", None), (1, 4, None, None)], "doc_id bigint, page int, text string, image_ratio double")
    assert sorted((r.page, r.needs) for r in L.needs_ocr(o).collect()) == [(1, False), (2, True), (3, True), (4, False)]

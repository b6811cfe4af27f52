import pytest

from vellumine.llm import ocr as O


@pytest.mark.parametrize("text, value", [("12", 12), ("l2", 12), ("1O9", 109), ("II9", 119), ("xiv", 14), ("lxxxiv", 84), ("x1", None), ("", None)])
def test_numbers(text, value):
    assert O.number(text) == value


@pytest.mark.parametrize("line, value", [("- 12 -", "12"), ("[l9]", "l9"), ("p. 23", "23"), ("Seite 54", "54"), ("99 / 210", "99"), ("— xiv —", "xiv"), ("356).", None), ("12.", None), ("Map 12", None), ("K12-3b", None), ("(see 12", None)])
def test_number_lines(line, value):
    assert O._number_line(line) == value


def test_fold_and_alike():
    assert O.fold("THE INDEX — MEBEHOF") == O.fold("THF lNDEX — MEBEH0F")
    assert O.alike("theindexmebehof", "theindxmebehof") and not O.alike("theindex", "thepreface") and not O.alike("abcd", "abce")


PAGES = [
    "THE MAP, SIZEHOF\n\nThe clerk copied the old cata-\nlogue. The well-\nknown map was kept and the\n\n12",
    "THE MAP, SlZEHOF\nlibrarian came. See:\n155\nThe end of it was near\n13",
    "14\nTHE MAP, SIZEHOF\nWho sold the p a p e r s of the\nhouse?",
]


def test_margins():
    text = "\n<!-- page 3 -->\n".join(PAGES)
    r = O.read(text, "export")
    lines = text.split("\n")
    assert sorted(lines[i] for i in r["heads"]) == ["THE MAP, SIZEHOF", "THE MAP, SIZEHOF", "THE MAP, SlZEHOF"]
    assert sorted(lines[i] for i in r["numbers"]) == ["12", "13", "14"]
    assert ("cata", "logue") in [c[2:4] for c in r["cuts"]] and r["spaced"] == [(next(i for i, x in enumerate(lines) if "p a p" in x), "papers")]


def test_repair():
    text = "HEAD\nThe clerk copied the old cata-\nlogue of tlie house and the well-\nknown map,\n\n12\n<!-- page 4 -->\nHEAD\n\nwhich was kept.\n\nNew p a p e r s came."
    lines = text.split("\n")
    drop = {i for i, x in enumerate(lines) if x in ("HEAD", "12")}
    out = O.repair(text, drop, {1}, {"tlie": "the"})
    assert out == ["The clerk copied the old catalogue of the house and the well-known map, which was kept.", "New papers came."]


def test_anagram_differences(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("therna", "thema"), ("abc", "cab")], "a string, b string")
    x = df.select((O.anagram(F.col("b")) - O.anagram(F.col("a"))).alias("d"), (O.anagram(F.lit("m")) - O.anagram(F.lit("rn"))).alias("e")).collect()
    assert x[0].d == x[0].e and x[1].d == 0


def test_corrections_against_brute_force(spark):
    words = {"thema": 500, "therna": 3, "thcma": 2, "demand": 300, "clemand": 4, "house": 90, "hause": 9, "anagram": 40, "margana": 3, "common": 100, "c0mmon": 1, "rare": 2, "rarc": 1, "et": 300, "ct": 2, "th\ufffdma": 1}
    vocab = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: (r.right, r.place) for r in O.corrections(vocab).collect()}
    want = {}
    for w, n in words.items():
        best = max(((m, v, i) for v, m in words.items() for a, b in O.CONFUSIONS for i in range(len(w)) if w[i : i + len(a)] == a and w[:i] + b + w[i + len(a) :] == v and m >= max(O.RATIO * n, O.FREQUENT) and v.isalpha() and (len(w) > 2 or m >= 100 * n)), default=None)
        if best:
            want[w] = (best[1], best[2])
    assert got.pop("th\ufffdma") == ("thema", 2)
    assert got == want and got["therna"] == ("thema", 3) and "hause" not in got and "margana" not in got


def test_queries(spark, tiny, empty, clashing):
    from vellumine.llm.queries import QUERIES as Q

    a = {tuple(r) for r in Q["p4_found"](spark, tiny).collect()}
    b = {tuple(r) for r in Q["p4_found"](spark, clashing).collect()}
    still = ("header", "page_number", "hyphen")
    assert a and {x for x in a if x[3] in still} == {x for x in b if x[3] in still}
    assert Q["p4_found"](spark, empty).count() == 0
    assert Q["p4_paragraphs"](spark, tiny).count() > 0 and Q["p4_paragraphs"](spark, empty).count() == 0


def test_headers_of_any_length_and_ending(spark):
    long_head = "Proceedings of the society for the history of printing and of the libraries of the northern provinces"
    ended = "Annals of the Old Library Soc."

    words = "amber bridge candle dragon ember falcon garden harbour island jasmine kettle lantern meadow nutmeg orchard pepper quarry ribbon saddle thistle".split()

    def book(head):
        lines = [[f"the {words[(3 * i + 7 * j) % 20]} of {words[(5 * i + j) % 20]} lay in {words[(i + 11 * j) % 20]}" for j in range(6)] for i in range(6)]
        return "\n".join(f"<!-- page {i + 1} -->\n{head}\n" + "\n".join(own) for i, own in enumerate(lines))

    rows = [("export", "1", 1, None, book(long_head)), ("export", "2", 2, None, book(ended))]
    items = spark.createDataFrame(rows, "origin string, item_id string, text_id bigint, page int, text string")
    got = {(r.item_id, r.line_no) for r in O.defects(items)[0].where("defect = 'header'").collect()}
    assert got == {(i, 8 * k + 1) for i in "12" for k in range(6)}


def test_headers_of_distant_pages_and_damaged_ones(spark):
    body = "the clerk kept a map of the {} town\nand nothing else was said of it"
    far = [("issue", f"f{p}", 1, p, "The Harbour Book\n" + body.format("abc"[k])) for k, p in enumerate((1, 60, 190))]
    heads = ("Register of Maps", "Regisler of Maps", "Register 0f Naps")
    near = [("issue", f"n{p}", 2, p, heads[k] + "\n" + body.format("def"[k])) for k, p in enumerate((5, 6, 7))]
    items = spark.createDataFrame(far + near, "origin string, item_id string, text_id bigint, page int, text string")
    got = {r.item_id for r in O.defects(items)[0].where("defect = 'header' and line_no = 0").collect()}
    assert got == {"f1", "f60", "f190", "n5", "n6", "n7"}


def test_filter_lets_every_word_pass(spark):
    words = spark.range(20_000).selectExpr("concat('wort', cast(id as string), 'ß') as word")
    f = O.word_filter(words, 1 << 18)
    assert all(f"wort{i}ß" in f for i in range(0, 20_000, 7))
    assert sum(f"anders{i}" in f for i in range(2000)) < 200


def test_alike_is_a_bounded_edit_distance():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    random.seed(3)
    for _ in range(3000):
        a = "".join(random.choice("abc") for _ in range(random.randint(6, 13)))
        b = "".join(c for c in a if random.random() > 0.1) + random.choice(["", "a", "bc"])
        want = a == b or (abs(len(a) - len(b)) <= 2 and min(len(a), len(b)) >= 6 and distance(a, b) <= (2 if len(a) >= 10 else 1))
        assert O.alike(a, b) == want

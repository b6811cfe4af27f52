import pytest

from vellumine.llm import pairs as P


@pytest.fixture(scope="module")
def model(spark, small):
    from vellumine.llm.queries import language_model

    return language_model(spark, small)


Q = "Who opened the map?\n\nThe clerk opened the map in the morning. The author sold the diary because the ink was fading."
T = "Translate into Spanish:\n\nThe clerk opened the map in the morning. The author sold the diary."
R = "Correct the passage without changing its meaning:\n\nThe clerk opened the map in the morning. The author sold the diary after the flood."


@pytest.mark.parametrize("mode, source, answer, defect", [
    ("question", Q, "The clerk", None), ("question", Q, "The clerk.", None), ("question", Q, "The clerk opened the map in the morning.", None), ("question", Q, "In the morning, the clerk opened the map.", None), ("question", Q, "**The clerk**\n", None),
    ("question", Q, "```\nThe clerk\n```", None), ("question", Q, "The clerk opened the m", "truncated"), ("question", Q, "In the morning, the cle…", "truncated"), ("question", Q, "Der Schreiber öffnete die Karte am Morgen.", "language"),
    ("question", Q, "who opened the map", "copy"), ("question", Q, Q.upper(), "copy"), ("question", Q, "> The clerk opened the map in the morning. The author sold the diary because the ink was fading.", "copy"),
    ("question", Q, "I'm sorry, but I can't help with that.", "refusal"), ("question", Q, "Lo siento, pero no puedo ayudar con esa petición.", "refusal"), ("question", Q, "N/A", "empty"), ("question", Q, None, "empty"), ("question", Q, " ​", "empty"), ("question", Q, "<p></p>", "empty"), ("question", Q, "```\n```", "empty"),
    ("translation", T, "La secretaria abrió el mapa por la mañana. El autor vendió el diario.", None), ("translation", T, "La secretaria abrió el mapa por la mañana. El aut", "truncated"), ("translation", T, "The clerk  opened the map in the morning. The author sold the diary", "copy"),
    ("translation", T, "Le secrétaire ouvrit la carte le matin. L'auteur vendit le journal.", "language"), ("translation", "Translate into Spanish:\n\nMS-75b, fol. 22", "MS-75b, fol. 22", None), ("translation", "Translate into Spanish:\n\nhttps://a.b/c.html", "https://a.b/c.html", None),
    ("translation", "Translate into Spanish:\n\n“I cannot help with that,” wrote Anna Weiss, and the clerk left the room.", "«No puedo ayudar con eso», escribió Anna Weiss, y la secretaria dejó la sala.", None),
    ("review_content", R, R.split("\n\n")[1], None), ("review_content", R, "The clerk opened the map in the morning. The author sold", "truncated"), ("review_content", R, "The clerk opened the map in the morning.", "truncated"),
    ("review_content", R, "La secretaria abrió el mapa por la mañana. El autor vendió el diario después de la inundación.", "language"),
])
def test_defects(model, mode, source, answer, defect):
    got = {r[1]: r[2] for r in P.judge([("x", mode, source, [answer], "The clerk.")], model)}
    assert got.get(0) == defect


def test_nulls_and_empties(model):
    assert P.judge([("a", "question", None, None, None)], model) == [("a", -1, "empty")]
    assert P.judge([("a", None, None, [], "I cannot comply with this request.")], model) == [("a", -1, "refusal")]
    assert P.judge([], model) == []


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    import random

    random.seed(1)
    for _ in range(200):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 40))] for _ in range(2))
        assert P.common(a, b) == slow(a, b)


def test_long_answer(model):
    text = "The clerk opened the map in the morning. " * 2000
    assert P.judge([("a", "review_content", "Correct:\n\n" + text, [text], text)], model) == []


def test_queries(spark, tiny, empty, clashing):
    from vellumine.llm.queries import QUERIES as Q

    a = {tuple(r) for r in Q["p6_found"](spark, tiny).collect()}
    assert a and len({x[:2] for x in a}) == len(a)
    assert {x for x in a if x[2] in ("empty", "refusal", "copy")} <= {tuple(r) for r in Q["p6_found"](spark, clashing).collect()}
    assert Q["p6_found"](spark, empty).count() == 0

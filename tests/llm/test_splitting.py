import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import splitting as S


def sound(text, limit, overlap):
    out = S.pieces(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in out)
    assert (not text and not out) or (out[0][0] == 0 and out[-1][1] == len(text))
    assert all(x[0] < y[0] <= x[1] < y[1] for x, y in zip(out, out[1:]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#-é中。", max_size=600), st.integers(5, 120), st.integers(0, 40))
def test_invariants(text, limit, overlap):
    sound(text, limit, overlap)


def test_no_boundaries():
    assert len(sound("x" * 1000, 100, 10)) >= 11
    assert sound("", 10, 2) == [] and sound("short", 10, 2) == [(0, 5)]


def test_chapters_win():
    body = "The cat sat on the mat and looked at the garden. " * 12
    text = f"# One\n\n{body}\n\n# Two\n\n{body}"
    first = sound(text, 900, 0)[0]
    assert text[first[1] :].startswith("# Two")


def test_topic_valley():
    a = ["The printer set the type and inked the press.", "The press printed the type of the printer.", "Ink and type and press served the printer."] * 3
    b = ["The gardener watered roses in the garden.", "Roses and tulips grew for the gardener.", "Tulips filled the garden with roses."] * 3
    random.seed(1)
    text = "\n\n".join(a + b)
    end = sound(text, 700, 0)[0][1]
    assert abs(end - text.index("The gardener")) <= 60


def test_overlap_near_the_wish():
    text = "".join(f"Sentence number {i} stands here as one of many. " for i in range(200))
    out = sound(text, 1000, 120)
    got = [x[1] - y[0] for x, y in zip(out, out[1:])]
    assert all(70 <= g <= 180 for g in got)


def test_queries(spark, tiny, empty, clashing):
    from vellumine.llm.queries import QUERIES as Q

    found = {tuple(r) for r in Q["p5_found"](spark, tiny).collect()}
    assert found == {tuple(r) for r in Q["p5_found"](spark, clashing).collect()}
    pieces = Q["p5_pieces"](spark, tiny)
    assert {(r.origin, r.item_id) for r in pieces.where("piece_no = 1").collect()} == found
    assert Q["p5_found"](spark, empty).count() == 0


def test_thai_has_boundaries_and_cohesion():
    text = "บรรณารักษ์เปิดแผนที่ในตอนเช้า ผู้แปลขายจดหมายให้พิพิธภัณฑ์ " * 160
    assert len(S.gaps(text)) > 100 and any(d > 0 for d in S.depths(text[:3000] + "เรือแล่นไปตามแม่น้ำสายใหญ่ ฝนตกหนักตลอดคืน " * 30, sorted(S.gaps(text[:3000]))))
    parts = S.pieces(text, 1000, 100)
    assert all(b - a <= 1000 for a, b in parts) and parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(p[1] >= q[0] > p[0] for p, q in zip(parts, parts[1:]))


@pytest.mark.parametrize("overlap", [0, 1, 60, 99])
def test_overlaps_up_to_the_limit(overlap):
    text = "The clerk copied the old map. " * 40
    parts = S.pieces(text, 100, overlap)
    assert all(0 < b - a <= 100 for a, b in parts) and all(p[1] >= q[0] > p[0] for p, q in zip(parts, parts[1:])) and parts[-1][1] == len(text)


def test_check(spark, tiny):
    from vellumine.llm.queries import QUERIES as Q

    r = Q["p5_check"](spark, tiny).first()
    assert r.items_in == r.items_out > 0 and r.too_long == r.with_gaps == r.wrong_text == 0

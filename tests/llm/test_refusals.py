import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import wordings

from vellumine.llm import refusals as R


def test_recall_of_wordings_in_no_list():
    found = [R.is_refusal(s) for s in wordings.REFUSALS]
    assert len(found) == 120 and sum(found) >= 108
    assert sum(found[1::2]) >= 54  # the half that served for nothing


def test_answers_with_denials_are_none():
    assert [s for s in wordings.ANSWERS if R.is_refusal(s)] == []


def test_a_refusal_told_in_the_passage():
    told = "The letter was short. I cannot comply with this request. The clerk left the room."
    assert not R.is_refusal("I cannot comply with this request.", told)
    assert R.is_refusal("I am unable to answer this question.", told)


def test_order_of_slots_counts():
    assert R.is_refusal("Unfortunately I cannot translate this text.")
    words = "text translate this cannot unfortunately".split()
    assert not any(lang.aligned(words) >= 0.99 for lang in R.languages())


def test_refusal_beside_other_sentences():
    assert R.is_refusal("I'm sorry, but I can't help with that. Please ask something else.")
    assert not R.is_refusal("I cannot translate this text. The clerk opened the map in the morning and sold the diary to the museum.")


def test_edges():
    assert not R.is_refusal("") and not R.is_refusal("…") and not R.is_refusal("no")
    assert not R.is_refusal("word " * 50_000)
    for s in ("我不能" * 20_000, "cannot " * 20_000):
        assert R.is_refusal(s) in (True, False)

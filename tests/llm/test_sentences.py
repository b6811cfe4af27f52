import re
import time

import pytest

from vellumine.llm import sentences as S

LEX = S.Lexicon()


def split(text, lex=LEX):
    out = S.sentences(text, lex)
    assert all(a < b <= c for (a, b), (c, _) in zip(out, out[1:]))
    assert all(text[a:b] == text[a:b].strip() for a, b in out)
    return [text[a:b] for a, b in out]


@pytest.mark.parametrize("parts", [
    ["See p. 12 and fig. 3 for the map.", "Dr. Anna Weiss came at 9:30 a.m. with it."], ["V. V. Paravik opened it (cf. vol. 13).", "The shelf held maps, letters, diaries, etc.", "It was 3.76 euros."],
    ["“Is it ready?” asked Anna.", "“I cannot help,” wrote Ben, and left!"], ["(Only 3 copies remain.)", "Who came?"], ["Version 2.36.1 is at https://a.b/c.html for all.", "It works…", "Fine."],
    ["«¿Ya está listo?» preguntó Ana.", "¡Qué largo fue!", "A las 9.30 a. m. la autora vino."], ["Am 3. Mai um ca. 9.30 Uhr kam er.", "Die Liste nennt z. B. die Karte, das Register usw. in Folge.", "Im Regal lagen Karten usw."],
    ["« Est-ce prêt ? » demanda M. Petit.", "Que l'hiver fut long !", "À 9 h env. il vint."], ["«Уже готово?» — спросил он.", "В 1931 г. писарь нашёл и т. д.", "Г. Иванов ушёл."], ["Il dott. Rossi venne.", "Mappe, lettere, ecc.", "Vedi pag. 3."],
])
def test_spaced(parts):
    assert split(" ".join(parts)) == parts
    assert split("\n".join(parts)) == parts


@pytest.mark.parametrize("parts", [["冬天真长啊！", "“准备好了吗？”他问道。", "（只剩9本。）", "书架上有地图、信件……", "完了"], ["「もうできましたか？」と彼はたずねた。", "（残っていない。）", "本を閉じた。"], ["सर्दी लंबी थी!", "“क्या यह तैयार है?” उसने पूछा।", "पृ. 12 देखें।"]])
def test_other_marks(parts):
    joined = "".join(parts) if re.match("[一-鿿ぁ-ん「]", parts[0]) else " ".join(parts)
    assert split(joined) == parts


def test_blocks_only():
    text = "# Heading. Not this.\n\nOne. Two\n\n- item. no\n\n> quote. no\n\n```\ncode. no\n\nmore. no\n```\n\n| a. | b |\n\nThree crosses\na line end. Four"
    assert split(text) == ["One.", "Two", "Three crosses\na line end.", "Four"]


@pytest.mark.parametrize("text", [None, "", "  \n", "# only. heading", "...", "\n\n\n"])
def test_nothing(text):
    assert S.sentences(text, LEX) == []


def test_long_text_is_linear():
    text = "The clerk copied the map of p. 3. " * 5000
    assert len(split(text)) == 5000


def test_thai(spark, small):
    from vellumine.llm.queries import _running

    lex = S.learn(_running(spark, small))
    assert lex.cost
    parts = ["ดูหน้า 83 และรูปที่ 21 เกี่ยวกับบัญชีรายการ", "เวลา 9.30 น. บรรณารักษ์ซ่อมปกหนังสือ", "“พร้อมหรือยัง” Anna Weiss ถามในตอนเช้า", "ฤดูหนาวช่างยาวนานเหลือเกิน"]
    got = split(" ".join(parts), lex)
    assert len(set(got) & set(parts)) >= 2  # a lexicon of a few dozen texts


def test_lattice_finds_words(spark):
    words = ["บรรณารักษ์", "เปิด", "แผนที่", "ปิด", "ผู้แปล", "จดหมาย", "ขาย"]
    runs = [a + b + c for a in (words[0], words[4]) for b in (words[1], words[3], words[6]) for c in (words[2], words[5])]
    lex = S.dictionary(spark.createDataFrame([(r,) for r in runs * 5], "text string"))
    assert lex.words("ผู้แปลขายแผนที่")[0].startswith("ผู้แปล") and "".join(lex.words("ผู้แปลขายแผนที่")) == "ผู้แปลขายแผนที่"


def test_statistics_are_of_all_texts(spark):
    """What stands at the end of long texts, and beyond any number of texts, teaches as well."""
    body = "ผู้แปล เปิด แผนที่ แล้ว " * 3000
    texts = [body + f"ท้าย{'กขคงจฉช'[i]}" for i in range(7)]
    lex = S.learn(spark.createDataFrame([("x", str(i), t) for i, t in enumerate(texts)], "origin string, item_id string, text string"))
    assert sum(lex.ends.values()) == 7 and sum(lex.after.values()) > 7 * 11_000


def test_long_thai_is_linear():
    text = "บรรณารักษ์เปิดแผนที่ ผู้แปลขายจดหมายในตอนเช้า (เหลือ 3 เล่ม) " * 6000
    t = time.perf_counter()
    S.sentences(text, LEX)
    assert len(text) > 344_000 and time.perf_counter() - t < 5


def test_a_long_quotation_is_one_sentence():
    inner = " ".join(f"Line {i} was read." for i in range(40))
    parts = ["It was late.", f"“{inner}” said Anna, and left.", "The end came."]
    assert split(" ".join(parts)) == parts
    assert len(split("An open (bracket. " + "It goes on. " * 30)) > 20  # one that never closes holds nothing together


def test_queries(spark, tiny, empty, clashing):
    from vellumine.llm.queries import QUERIES as Q

    a = sorted(map(tuple, Q["p3_found"](spark, tiny).collect()))
    assert a and a == sorted(map(tuple, Q["p3_found"](spark, clashing).collect()))
    assert Q["p3_found"](spark, empty).count() == 0

from pathlib import Path

import numpy as np
import pytest

from vellumine.llm import langid as L
from vellumine.llm.blocks import blocks


@pytest.fixture(scope="module")
def model(spark, small):
    from vellumine.llm.queries import language_model

    return language_model(spark, small)


@pytest.mark.parametrize("label, code", [("en", "en"), ("EN", "en"), ("en_GB", "en"), ("spa", "es"), ("Español", "es"), ("zh-Hans", "zh"), ("pt-BR", "pt"), (None, None), (" ", None), ("und", None), ("n/a", None), ("??", None), ("nl", "?"), ("dutch", "?")])
def test_labels(label, code):
    assert L.code_of(label) == code


def test_gradients():
    """Backpropagation through time against differences."""
    n = L.Network.new(["a", "b", "c"], 3)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    codes, live = L.encode(["ab", "xyz"])
    y = np.array([[1, 0, 0], [0, 0.5, 0.5]])

    def loss():
        z = n.logits(codes, live)[0]
        z = z - z.max(2, keepdims=True)
        z = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -(z * y[None] * live[:, :, None]).sum() / live.sum()

    out, h, x, tf, tb = n.logits(codes, live, keep=True)
    p = np.exp(out - out.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    d = (p - y[None]) * live[:, :, None] / live.sum()
    grad: dict = {}
    dh = d @ n.p["o"].T
    n._back(dh[:, :, : L.HIDDEN], x, tf, "f", grad)
    n._back(np.ascontiguousarray(dh[::-1, :, L.HIDDEN :]), np.ascontiguousarray(x[::-1]), tb, "b", grad)
    for k in ("uf", "wf", "cf", "ub", "wb", "cb"):
        flat = n.p[k].reshape(-1)
        i = int(np.abs(grad[k]).argmax())
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-3 - grad[k].reshape(-1)[i]) < 2e-3


def test_held_out_accuracy(spark, small, model):
    """On translations of other tables, none of whose texts the fitting tables hold."""
    own = {r.expected for r in spark.read.parquet(f"{small}/translation_cases.parquet").select("expected").collect()}
    other = small.replace("sf0.01", "sf0.1")
    if not Path(other).exists():
        pytest.skip("no other tables")
    rows = spark.read.parquet(f"{other}/translation_cases.parquet").where("target_lang is not null and length(expected) > 30").select("expected", "target_lang").distinct().collect()
    rows = [r for r in rows if r.expected not in own]
    got = L.label_texts(model, [r.expected for r in rows])
    right = sum(g[0] == r.target_lang for g, r in zip(got, rows))
    assert len(rows) > 1000 and right / len(rows) > 0.99


@pytest.mark.parametrize("word", ["अंतरराष्ट्रीयकरण", "достопримечательности", "Donaudampfschifffahrtsgesellschaftskapitän", "x" * 5000])
def test_long_words_are_read_whole(word):
    runs = L._runs(word.lower())
    assert "".join(runs) == word.lower() and all(len(r) <= L.RUN for r in runs)
    codes, live = L.encode(runs)
    assert live.sum() == sum(len(r.encode()) + 2 for r in runs)


def test_memory_is_only_a_cache(monkeypatch, model):
    fresh = L.Model(model.network)
    texts = ["eins zwei drei vier fünf", "uno dos tres cuatro cinco eins zwei", " ".join(f"wort{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))]
    want = fresh.score(texts)
    monkeypatch.setattr(L, "MEMO", 50)
    small = L.Model(model.network)
    for t, w in zip(texts, want):
        assert np.allclose(small.score([t])[0], w, atol=1e-3)
    assert len(small.memo) <= 50


def test_fitted_once(spark, tmp_path):
    rows = [("the clerk kept the old map of the harbour", "en"), ("la secretaria guardó el mapa viejo del puerto", "es")] * 3
    a, b = L.fit_once(spark, rows), L.fit_once(spark, rows)
    assert all(np.array_equal(a.network.p[k], b.network.p[k]) for k in a.network.p)


def test_blocks_and_mixed(model):
    en = "The librarian kept the table of contents in the reading room. Who opened the map in the morning? The museum sold the old catalogue."
    de = "Der Drucker kopierte das Vorwort vor dem zweiten Druck. Die Schreiberin fand die Karte im Lesesaal. Wie lang der Winter war!"
    text = f"# The map\n\n{en}\n\n{de}\n\n```\nder die das\n\nund\n```\n\n{en}"
    lang, sure, found = L.label_texts(model, [text])[0]
    assert lang == "en" and 0 < sure <= 1
    assert [(no, x) for no, x, _ in found] == [(1, "en"), (2, "de"), (5, "en")]


@pytest.mark.parametrize("text", [None, "", " \n", "12 34", "```\ncode\n```"])
def test_nothing(model, text):
    assert L.label_texts(model, [text])[0][0] is None


def test_scripts(model):
    for text, code in [("北方的图书馆保存了旧目录。", "zh"), ("図書館は目次を保管した。", "ja"), ("Библиотека сохранила каталог.", "ru"), ("مكتبة قديمة في المدينة", "ar"), ("पुस्तकालय ने सूची को सँभाला।", "hi"), ("หอสมุดเก็บสารบัญไว้", "th")]:
        assert L.label_texts(model, [text])[0][0] == code


def test_long_text(model):
    assert L.label_texts(model, ["The clerk copied the map. " * 20_000])[0][0] == "en"


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(L, "MEMO", 50)
    a = model.score([f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again" for i in range(200)])
    assert a.shape[0] == 200 and a.any(1).all()


def test_block_numbers():
    t = "---\ntitle: x\n---\n\n# h\n \t\ntext\nmore\r\n\r\n- l\n\n> q\n\n| a |\n|---|\n\n```\na\n\nb\n```\n\n<!-- c -->\n\nlast"
    assert [(b.no, b.kind) for b in blocks(t)] == [(0, "front"), (1, "heading"), (2, "text"), (3, "list"), (4, "quote"), (5, "table"), (6, "code"), (7, "code"), (8, "comment"), (9, "text")]


def test_queries(spark, tiny, empty, clashing):
    from vellumine.llm.queries import QUERIES as Q

    a = {tuple(r) for r in Q["p2_found"](spark, tiny).collect()}
    assert a and all(isinstance(r[2], int) for r in a)
    assert Q["p2_found"](spark, clashing).columns == ["origin", "item_id", "block_no", "lang"]
    assert Q["p2_found"](spark, empty).count() == 0 and Q["p2_segments"](spark, empty).count() == 0


def test_sample_counts_copies_once(spark):
    rows = [(str(i), "The same page stands under many ids, and it is this one.", "en") for i in range(400)]
    rows += [(f"x{c}", f"The clerk copied the map of {c} before the winter came.", "en") for c in "abcdefghij"]
    got = L.sample([spark.createDataFrame(rows, "id string, text string, lang string")], 8)
    assert len(got) == len(set(got)) == 8 and L.sample([spark.createDataFrame(rows[:400], "id string, text string, lang string")], 8) == [(rows[0][1], "en")]


def test_network_is_fitted_on_all_rows(spark, monkeypatch):
    """Beyond any number of rows of a language and of characters of a row, however the rows are spread."""
    monkeypatch.setattr(L, "STEPS", 3)
    monkeypatch.setattr(L, "AGAIN", 2)
    seen = []
    monkeypatch.setattr(L.Network, "train", lambda self, runs, targets, weights, steps, seed: seen.append((runs, targets, weights)))
    names = [f"{a}{b}{c}ling" for a in "bdfg" for b in "aeio" for c in "bcdfghklmnprst"]
    rows = [(str(i), f"The clerk met {w} in the reading room.", "en") for i, w in enumerate(names)]
    rows += [("long", "Der Drucker las den Text. " * 1200 + "Am Ende kam Schlusswort.", "de"), ("short", "Ja, gern", "de"), ("none", None, "de"), ("blank", " ", "en")]
    rows += [(f"copy{i}", rows[0][1], "en") for i in range(50)]
    frame = spark.createDataFrame(rows, "id string, text string, lang string")
    L.fit_once(spark, L.texts_once([frame.repartition(5)]))
    runs = seen[0][0]
    assert len(seen) == 2 and len(names) > 200 and set(names) | {"schlusswort", "gern"} <= set(runs)
    counts = {(c, r): n for c, r, n in L.counted(L.texts_once([frame.coalesce(1)]))}
    assert counts["en", "the"] == 2 * len(names) and counts["en", None] == 8 * len(names) and counts["de", "text"] == 1200


def test_runs_of_many_texts_are_those_of_each():
    texts = ["", "12", "々aɐ𐀀b" + "x" * 130 + "図書館は目次を保管した漢字漢字漢字漢字漢字ｦｧ ـ؟عaи", "หอสมุดเก็บสารบัญไว้ 1", "पुस्तकालय ने सूची को सँभाला।", "The map"]
    runs, place, owner = L._split(texts)
    assert [[runs[p] for p, o in zip(place, owner) if o == i] for i in range(len(texts))] == [L._runs(t) for t in texts]
    assert L._split(["", "1"])[0] == []


def test_a_long_text_counts_as_its_pieces(monkeypatch, model):
    text = "Der Drucker las den Text im Lesesaal am Morgen. " * 400
    want = sorted(L.run_counts([(text, "en"), ("la carta", "es")], model), key=str)
    monkeypatch.setattr(L, "SLICE", 500)
    monkeypatch.setattr(L, "COUNTED", 5)
    got = sorted(L.run_counts([(text, "en"), ("la carta", "es")], model), key=str)
    assert got == want and ("de", "drucker", 400) in got and not any(c == "en" for c, _, _ in got)


def test_common_runs_go_with_the_model(model, monkeypatch):
    """They pass the network once, not once in each worker, and in any case of letters."""
    import pickle

    sent = pickle.loads(pickle.dumps(L.Model(model.network).prepare(["the", "map"])))
    want = L.Model(model.network).score(["The map", "MAP the the"])
    assert len(pickle.loads(pickle.dumps(L.Model(model.network))).memo) == 0
    monkeypatch.setattr(L.Network, "pooled", None)  # nothing is left for it
    assert np.allclose(sent.score(["The map", "MAP the the"]), want, atol=1e-5)


def test_texts_cleaned_together():
    noise = L.re.compile(r"https?://\S+|`[^`\n]*`|<[^<>\n]+>|\b\S+@\S+")
    texts = ["see http://a.b/<c> or x@y.z\n- `a <b\n> c` <d\n(me@there.org) `e@f` g", "@", "", "a <b> c", "`x` @y z@", "a\n@b\n`c`\nhttps://d e@f"]
    want = [noise.sub(" ", t) for t in texts]
    assert [L._clean(t) for t in texts] == L._cleaned(texts) == want and L._cleaned([*texts, "a\0 <b>"]) == [*want, "a\0  "]


def test_ends_of_sentences():
    text = "“A b.” C! D… 1.5 e.\n- f\n# g。」甲！ 乙 h؟ i."
    stop = L.re.compile(r"(?<=[.!?…])[\"”’»“)\]]*\s+|(?<=[。！？।؟])[”’」』»）)]*\s*|\n(?=[-*|#>])")
    for t in (text, text[:28], "", " . ", "a"):
        assert L.sentences(t) == [s for s in stop.split(t) if s and s.strip()]


def test_models_of_languages_and_residue_share_one_shuffle(spark, tiny, monkeypatch):
    """As good as each fitted alone; no text is shuffled again after its wording is known."""
    from vellumine.llm import queries as Q
    from vellumine.llm import residue as R

    plans = []
    monkeypatch.setattr(L, "once", lambda rows, once=L.once: (plans.append(once(rows)._jdf.queryExecution().executedPlan().toString()), once(rows))[1])
    languages, residues = Q._language_and_residue_models(spark, tiny)
    assert len(plans) == 1 and "Exchange" not in plans[0].split("InMemoryTableScan")[0]
    alone = Q.language_model(spark, tiny)
    assert all(np.array_equal(languages.network.p[k], alone.network.p[k]) for k in alone.network.p)
    want = R.fit(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert all(np.array_equal(getattr(residues, k), getattr(want, k)) for k in ("ratios", "slots", "shapes"))

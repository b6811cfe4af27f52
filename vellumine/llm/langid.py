"""Languages of texts and of their blocks, by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each run of letters (a word, or a stretch of a spaceless script) in both directions and
labels every position with a distribution over the languages. Positions are pooled into runs, runs into sentences,
sentences into blocks and whole texts. It is trained in numpy by backpropagation through time, on runs counted in all
labelled rows, whole. Labels may be wrong: after a first training, texts whose own pooled language contradicts their
label are put under the language they are in, all are counted again, and training goes on.
The languages whose script cannot have written a run are excluded by the table of scripts.

Runs are remembered per worker with their pooled values, up to a bound, so common words pass the network once.

Null, empty and blank texts give nothing; a text without letters has no language; ties go to the alphabetically first
code; repeated rows give the same result and count once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import RUNNING, blocks, wording

EMBED, HIDDEN = 12, 28  # sizes of the network
WORD = 2  # characters of a word of a spaceless script
RUN = 48  # characters of a run; longer ones are several
LENGTHS = (14, 22, 34, 10**9)  # runs of a training batch are alike in length: bytes
STEPS, AGAIN, BATCH, RATE = 700, 300, 192, 0.02
RUNS = 6000  # most frequent runs of a language that train
MEMO = 400_000  # remembered runs of a worker
SLICE = 1_000_000  # characters scored or counted at a time
COUNTED = 300_000  # runs whose counts a task holds at a time
SURE = 0.9  # probability of another language that a wrong label needs
MARGIN = 1.2  # log-odds by which a sentence has a language
DOUBT = 3.0  # log-odds that a text's own language needs against the one of its label
EVIDENCE = 5.0  # log-odds by which a block is in another language than its text

#: Spellings of languages (fixed values): codes of two and three letters, English and own names.
NAMES = {
    "en": "en eng english inglés ingles inglese anglais englisch английский 英语 英語",
    "es": "es spa spanish español espanol castellano espagnol spagnolo spanisch espanhol",
    "fr": "fr fra fre french français francais francés francese französisch francês",
    "de": "de deu ger german deutsch alemán aleman allemand tedesco alemão",
    "pt": "pt por portuguese português portugues portugués portugais portoghese portugiesisch",
    "it": "it ita italian italiano italien italienisch",
    "ru": "ru rus russian русский ruso russe russo russisch",
    "zh": "zh zho chi cmn chinese 中文 汉语 chino chinois cinese chinesisch chinês",
    "ja": "ja jpn japanese 日本語 japonés japones japonais giapponese japanisch japonês",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ar": "ar ara arabic العربية árabe arabe arabo arabisch",
    "th": "th tha thai ไทย ภาษาไทย tailandés thaï thailandese thailändisch tailandês",
}
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}
LATIN = ("de", "en", "es", "fr", "it", "pt")
#: Scripts of languages (fixed values), where no table of language codes is given.
SCRIPTS = {"Latin": LATIN, "Cyrillic": ("ru",), "Han": ("ja", "zh"), "Kana": ("ja",), "Devanagari": ("hi",), "Arabic": ("ar",), "Thai": ("th",)}

_RUN = re.compile(
    r"(?P<Kana>[぀-ヿㇰ-ㇿｦ-ﾟ]{1,8})|(?P<Han>[々㐀-䶿一-鿿豈-﫿]{1,8})|(?P<Thai>[฀-๿]{1,9})"
    rf"|(?P<Devanagari>[ऀ-ॣ॰-ॿ]{{1,{RUN}}})|(?P<Arabic>[ؐ-ٟؠ-ۿݐ-ݿ]{{1,{RUN}}})|(?P<Cyrillic>[Ѐ-ӿ]{{1,{RUN}}})|(?P<Latin>[A-Za-zÀ-ÖØ-öø-ɏ]{{1,{RUN}}})"
)
_ANY = re.compile(re.sub(r"\?P<\w+>", "?:", _RUN.pattern))
_LATIN = re.compile(rf"[A-Za-zÀ-ÖØ-öø-ɏ]{{1,{RUN}}}")
_FAR = re.compile(r"[Ā-῿⺀-\uffff]")
_LETTERS = bytes(c if c == 0 or _LATIN.match(chr(c)) else 32 for c in range(256))
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_SPACELESS = re.compile(r"[\u0e00-\u0e7f\u3040-\u9fff\uff66-\uff9f]")
_OTHER = re.compile(r"[Ͱ-῿⺀-\uffff]")
_NOISE = {"://": r"https?://\S+", "`": r"`[^`\n]*`", "<": r"<[^<>\n]+>", "@": r"\b\S+@\S+"}  # what is no language, by a sign that it holds
_STOP = re.compile(r"([.!?…])[\"”’»“)\]]*\s+|\n(?=[-*|#>])")
_WIDE_STOP = re.compile(r"[。！？।؟]")
_ANY_STOP = re.compile(r"[.!?…]([\"”’»“)\]]*\s+)|[。！？।؟]([”’」』»）)]*\s*)|(\n)(?=[-*|#>])")


def code_of(label: str | None) -> str | None:
    """The code that a label spells, '?' for a language outside the table, None where it names none."""
    if label is None:
        return None
    name = label.strip().lower()
    if not name or name in ("und", "unknown", "xx", "n/a", "na", "??", "?", "none", "null", "mul", "zxx", "mis", "-", "other"):
        return None
    if name in _CODE:
        return _CODE[name]
    head = re.split(r"[-_ (]", name)[0]
    if head in _CODE:
        return _CODE[head]
    return "?" if re.search(r"[^\W\d_]{2}", name) else None


@cache
def _noise(signs: str) -> re.Pattern:
    return re.compile("|".join(x for sign, x in _NOISE.items() if sign in signs))


def _clean(text: str) -> str:
    """A text with blanks for its addresses, code and tags, none of which goes beyond a line."""
    signs = [x for x in _NOISE if x in text]
    if not signs:
        return text
    clean = partial(_noise("".join(signs)).sub, " ")
    if "@" not in signs:
        return clean(text)
    plain = _noise("".join(signs[:-1])).sub if len(signs) > 1 else lambda _, t: t
    out, at = [], 0  # addresses are sought at every word, so only in the lines that have their sign
    while (k := text.find("@", at)) >= 0:
        a, b = text.rfind("\n", at, k) + 1 or at, text.find("\n", k) + 1 or len(text)
        out += [plain(" ", text[at:a]), clean(text[a:b])]
        at = b
    return "".join([*out, plain(" ", text[at:])])


def _cleaned(texts: list[str]) -> list[str]:
    """_clean of many texts at once."""
    joined = "\n\0\n".join(texts)
    if joined.count("\0") >= len(texts):
        return [_clean(t) for t in texts]
    return _clean(joined).split("\n\0\n") if texts else []


def _runs(text: str) -> list[str]:
    """The runs of letters of a text, each of one script."""
    return (_LATIN if _OTHER.search(text) is None else _ANY).findall(text)


def _script(run: str) -> str:
    return _RUN.match(run).lastgroup


def _near(text: str) -> bool:
    """Whether no letter of a text lies beyond Latin-1."""
    return text.isascii() or _FAR.search(text) is None


def _split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of texts; and of every run, in its order, its place among these and its text.

    The runs are those of _runs. Where no letter lies beyond Latin-1, those of all such texts are cut at once.
    """
    near, far = [], []
    for i, t in enumerate(texts):
        (near if _near(t) else far).append(i)
    parts = [texts[i] for i in near]
    joined = " \0 ".join(parts)
    if joined.count("\0") >= max(1, len(near)):
        joined = " \0 ".join(t.replace("\0", " ") for t in parts)
    cut = [joined.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1")] if near else []
    runs, place = _distinct(" \0 ".join([*cut, *(" ".join(_runs(texts[i])) for i in far)]))
    if max(map(len, runs), default=0) > RUN:
        far, near = range(len(texts)), []
        runs, place = _distinct(" \0 ".join(" ".join(_runs(t)) for t in texts))
    if "\0" not in runs:
        return runs, place, np.full(len(place), [*near, *far][0] if texts else 0)
    zero = runs.index("\0")
    runs.pop(zero)
    letters = place != zero
    owner = np.array([*near, *far])[np.cumsum(~letters)[letters]]
    place = place[letters]
    place -= place > zero
    if near and far:
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
    return runs, place, owner


def _distinct(words: str) -> tuple[list[str], np.ndarray]:
    """The distinct words of a text with blanks between them, and the place of each word among these."""
    data = np.frombuffer(words.encode() + b" ", np.uint8)
    keep = data != 32
    keep[1:] |= keep[:-1]  # one blank after each word
    data = data[keep]
    ends = np.flatnonzero(data == 32)
    at = np.zeros(len(ends) + 1, np.int32)
    at[1:] = ends + 1
    found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    return [w[:-1].decode() for w in found.dictionary.to_pylist()], found.indices.to_numpy().astype(np.int64)


# ---- network ---------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """p: embedding, input, recurrent and bias weights of both directions, and the output layer."""

    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"e": n(256, EMBED) * 4, "o": n(2 * HIDDEN, len(languages)), "ob": np.zeros(len(languages), np.float32)}
        for d in "fb":
            p |= {f"w{d}": n(EMBED, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(languages, p)

    def _pass(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step, [time, row, hidden]; x: embedded bytes in reading order."""
        w, u, c = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        xs = x @ w + c
        states, trace = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)):
            a = _sigmoid(xs[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = a[:, :HIDDEN], a[:, HIDDEN:]
            n = np.tanh(xs[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            m = live[t][:, None]
            new = (1 - z) * h + z * n
            if not m.all():
                new = m * new + (1 - m) * h
            if keep:
                trace.append((h, z, r, n, m))
            h = new
            states[t] = h
        return states, trace

    def logits(self, codes: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple:
        x = self.p["e"][codes]
        f, tf = self._pass(x, live, "f", keep)
        b, tb = self._pass(x[::-1], live[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["o"] + self.p["ob"], h, x, tf, tb

    def _back(self, dh: np.ndarray, x: np.ndarray, trace: list, d: str, grad: dict) -> np.ndarray:
        """Backpropagation through time; gives the gradient of the embedded bytes, in reading order."""
        w, u = self.p[f"w{d}"], self.p[f"u{d}"]
        du = np.zeros_like(u)
        da_all = np.empty((len(x), x.shape[1], 3 * HIDDEN), np.float32)
        carry = np.zeros_like(dh[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, m = trace[t]
            g = dh[t] + carry
            live = g * m
            dn = live * z * (1 - n * n)
            dz = live * (n - h) * z * (1 - z)
            drh = dn @ u[:, 2 * HIDDEN :].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr], axis=1)
            du[:, : 2 * HIDDEN] += h.T @ da
            du[:, 2 * HIDDEN :] += (r * h).T @ dn
            da_all[t, :, : 2 * HIDDEN] = da
            da_all[t, :, 2 * HIDDEN :] = dn
            carry = g * (1 - m) + live * (1 - z) + drh * r + da @ u[:, : 2 * HIDDEN].T
        flat = da_all.reshape(-1, 3 * HIDDEN)
        grad[f"u{d}"] = du
        grad[f"w{d}"] = x.reshape(-1, EMBED).T @ flat
        grad[f"c{d}"] = flat.sum(0)
        return da_all @ w.T

    def train(self, runs: list[str], targets: np.ndarray, weights: np.ndarray, steps: int, seed: int) -> None:
        """targets: [run, language] probabilities. Adam, batches drawn by weight."""
        r = np.random.default_rng(seed)
        codes, live = encode(runs)
        sizes = live.sum(0)
        classes = [c for c in (np.flatnonzero((sizes <= high) & (sizes > low)) for low, high in zip((0, *LENGTHS), LENGTHS)) if len(c)]
        shares = np.array([weights[c].sum() for c in classes])
        shares = shares / shares.sum()
        draws = [weights[c] / weights[c].sum() for c in classes]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            k = int(r.choice(len(classes), p=shares))
            at = classes[k][r.choice(len(classes[k]), BATCH, p=draws[k])]
            top = int(live[:, at].sum(0).max())
            c, lv, y = codes[:top, at], live[:top, at], targets[at]
            out, h, x, tf, tb = self.logits(c, lv, keep=True)
            out -= out.max(2, keepdims=True)
            p = np.exp(out)
            p /= p.sum(2, keepdims=True)
            d = (p - y[None]) * lv[:, :, None] / lv.sum()
            grad = {"o": h.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2]), "ob": d.sum((0, 1))}
            dh = d @ self.p["o"].T
            dx = self._back(dh[:, :, :HIDDEN], x, tf, "f", grad)
            dx = dx + self._back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), np.ascontiguousarray(x[::-1]), tb, "b", grad)[::-1]
            grad["e"] = np.zeros_like(self.p["e"])
            np.add.at(grad["e"], c, dx)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)

    def pooled(self, runs: list[str]) -> np.ndarray:
        """[run, language]: mean over the positions of their log probabilities."""
        out = np.empty((len(runs), len(self.languages)), np.float32)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        for a in range(0, len(order), 1024):
            at = order[a : a + 1024]
            codes, live = encode([runs[i] for i in at])
            z = self.logits(codes, live)[0]
            z = z - z.max(2, keepdims=True)
            z -= np.log(np.exp(z).sum(2, keepdims=True))
            w = live[:, :, None]
            out[at] = (z * w).sum(0) / np.maximum(w.sum(0), 1)
        return out


def encode(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and liveness, [time, run]; a run is wrapped in blanks and read whole."""
    raw = [b" " + r.lower().encode("utf-8", "replace") + b" " for r in runs]
    codes = np.zeros((max(map(len, raw), default=1), len(runs)), np.int64)
    live = np.zeros(codes.shape, np.float32)
    for i, b in enumerate(raw):
        codes[: len(b), i] = np.frombuffer(b, np.uint8)
        live[: len(b), i] = 1
    return codes, live


# ---- model -----------------------------------------------------------------------------------------------------


class Model:
    """A trained network with the memory of pooled runs."""

    def __init__(self, network: Network, scripts: dict[str, tuple[str, ...]] = SCRIPTS) -> None:
        self.network = network
        at = {c: i for i, c in enumerate(network.languages)}
        self.masks = {}
        for script, codes in scripts.items():
            mask = np.full(len(at), -12.0, np.float32)
            for c in codes:
                if c in at:
                    mask[at[c]] = 0
            self.masks[script] = mask
        self.memo: dict[str, int] = {}
        self.values = np.empty((0, len(at)), np.float32)
        self.filled = self.prepared = 0

    def __getstate__(self) -> dict:
        n = self.prepared
        return {"network": self.network, "masks": self.masks, "memo": dict(islice(self.memo.items(), n)), "values": self.values[:n], "filled": n, "prepared": n}

    def prepare(self, runs: list[str]) -> "Model":
        """Remembers runs, as the network reads them, which then go to the executors with the model: RUNS of each language at most."""
        if runs:
            self._remember(runs, self._values(runs))
            self.prepared = self.filled
        return self

    def _values(self, runs: list[str]) -> np.ndarray:
        z = self.network.pooled(runs) + np.stack([self.masks[_script(r)] for r in runs])
        z -= z.max(1, keepdims=True)
        return np.maximum(z - np.log(np.exp(z).sum(1, keepdims=True)), -6.0)

    def _remember(self, runs: list[str], z: np.ndarray) -> None:
        if len(self.memo) + len(runs) > MEMO:
            self.memo.clear()
            self.filled = self.prepared = 0
        if len(runs) > MEMO:
            return
        if self.filled + len(runs) > len(self.values):
            grown = np.empty((max(2 * len(self.values), self.filled + len(runs), 4096), z.shape[1]), np.float32)
            grown[: self.filled] = self.values[: self.filled]
            self.values = grown
        self.values[self.filled : self.filled + len(runs)] = z
        for i, r in enumerate(runs):
            self.memo[r] = self.filled + i
        self.filled += len(runs)

    def score(self, texts: list[str]) -> np.ndarray:
        """[text, language] pooled log probabilities, not normalised; zero where a text has no letters."""
        out = np.zeros((len(texts), len(self.network.languages)), np.float32)
        first, size = 0, 0
        for i, t in enumerate(texts):  # in slices, so that memory does not grow with the batch
            size += len(t)
            if size > SLICE or i == len(texts) - 1:
                self._slice(texts[first : i + 1], out[first : i + 1])
                first, size = i + 1, 0
        return out

    def _slice(self, texts: list[str], out: np.ndarray) -> None:
        self._pool(*_split(_cleaned(texts)), out)

    def _pool(self, distinct: list[str], place: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Adds up the values of the runs of each text, as _split gives them."""
        if not distinct:
            return
        low = [r.lower() for r in distinct]  # as the network reads them
        known = np.array([self.memo.get(r, -1) for r in low])
        values = np.empty((len(distinct), out.shape[1]), np.float32)
        values[known >= 0] = self.values[known[known >= 0]]
        new = np.flatnonzero(known < 0).tolist()
        if new:
            fresh = {low[i]: distinct[i] for i in new}
            z = self._values(list(fresh.values()))
            at = {r: k for k, r in enumerate(fresh)}
            values[new] = z[[at[low[i]] for i in new]]
            self._remember(list(fresh), z)
        wide = np.array([max(1.0, len(r) / WORD) if r[0] > "\u0dff" and _SPACELESS.match(r) else 1.0 for r in distinct], np.float32)
        values *= wide[:, None]  # a run of a spaceless script is as many words as it is long
        sizes = np.bincount(owner, minlength=len(out))
        has = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[has]
        out[has] = np.add.reduceat(values[place], starts, axis=0)

    def best(self, scores: np.ndarray) -> tuple[list[str | None], np.ndarray]:
        """The language of each row of scores and its confidence, a probability."""
        z = scores - scores.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        some = scores.any(1)
        return [self.network.languages[k] if s else None for k, s in zip(top, some)], np.where(some, p[np.arange(len(p)), top], 0.0)


def _pieces(text: str) -> list[str]:
    """A text in pieces of at most SLICE characters, cut after a blank where there is one."""
    out, at = [], 0
    while len(text) - at > SLICE:
        end = text.rfind(" ", at + SLICE // 2, at + SLICE) + 1 or at + SLICE
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def run_counts(texts: Iterable[tuple[str, str]], model: Model | None = None) -> Iterator[tuple[str, str | None, int]]:
    """(code, run, n): how often each run stands in texts under a code, in parts that add up; with no run, all runs of it.

    texts: (text, code). With a model, a text that is surely in another language counts under that one.
    """
    total: dict[str, Counter] = {}

    def count(held: list[tuple[str, str]]) -> None:
        # one long text in pieces, or several short ones
        parts = [[t for t, _ in held]] if len(held) > 1 else [[p] for p in _pieces(held[0][0])]
        codes = [c for _, c in held]
        found = [_split(_cleaned([t.lower() for t in p])) for p in parts] if len(parts) == 1 else None
        again = lambda: found or (_split(_cleaned([t.lower() for t in p])) for p in parts)
        if model:
            scores = np.zeros((len(held), len(model.network.languages)), np.float32)
            for runs, place, owner in again():
                own = np.zeros_like(scores)
                model._pool(runs, place, owner, own)
                scores += own
            named, sure = model.best(scores)
            codes = [n if n and s > SURE else c for n, s, c in zip(named, sure, codes)]
        names = sorted(set(codes))
        label = np.array([names.index(c) for c in codes])
        for runs, place, owner in again():
            n = np.bincount(label[owner] * len(runs) + place, minlength=len(names) * len(runs)).reshape(len(names), len(runs)) if runs else ()
            for c, row in zip(names, n):
                mine = total.setdefault(c, Counter())
                mine[None] += int(row.sum())
                for i in np.flatnonzero(row).tolist():
                    mine[runs[i]] += int(row[i])

    def flush() -> Iterator[tuple[str, str | None, int]]:
        for c, mine in total.items():
            for r, n in mine.items():
                yield c, r, n
        total.clear()

    held: list[tuple[str, str]] = []
    size = 0
    for row in texts:
        if held and size + len(row[0]) > SLICE:
            count(held)
            held, size = [], 0
            if sum(map(len, total.values())) > COUNTED:
                yield from flush()
        held.append(row)
        size += len(row[0])
    if held:
        count(held)
    yield from flush()


def counted(texts: DataFrame, model: Model | None = None) -> list[tuple[str, str | None, int]]:
    """run_counts summed over all texts: of each code the number of all its runs, and its RUNS most frequent ones, ties by spelling."""
    from pyspark.sql import Window

    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = run_counts(((t, c) for b in batches for t, c in zip(b["text"], b["code"])), shared.value)
        while some := list(islice(rows, 50_000)):
            yield pd.DataFrame(some, columns=["code", "run", "n"])

    sums = texts.select("code", "text").mapInPandas(run, "code string, run string, n bigint").groupBy("code", "run").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("code").orderBy(F.col("run").isNotNull(), F.desc("n"), "run")
    few = sums.withColumn("k", F.row_number().over(order)).where(F.col("k") <= RUNS + 1).select("code", "run", "n")
    return sorted(map(tuple, few.collect()), key=lambda r: (r[0], r[1] or ""))  # RUNS for each of a dozen languages


def examples(counts: list[tuple[str, str | None, int]], languages: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The runs that train, their shares of the languages, and their weights."""
    at = {c: i for i, c in enumerate(languages)}
    total = {c: n for c, r, n in counts if r is None}
    share: dict[str, np.ndarray] = {}
    for c, r, n in counts:
        if r is not None:
            share.setdefault(r, np.zeros(len(languages)))[at[c]] += n / total[c]
    runs = sorted(share)
    s = np.stack([share[r] for r in runs]) if runs else np.ones((1, len(languages)))
    w = s.sum(1)
    return runs or [" "], (s / w[:, None]).astype(np.float32), w**0.6


def _trained(spark: SparkSession, counts: list[tuple[str, str | None, int]], steps: int, seed: int, before: tuple[str, Network] | None = None) -> tuple[str, Network]:
    """The network trained on counts, and its digest; one that was trained on the same before is loaded from the checkpoint folder."""
    from ..session import shared_folder

    said = hashlib.sha256(repr((steps, seed, BATCH, EMBED, HIDDEN, RUN, before and before[0], counts)).encode("utf-8", "surrogatepass")).hexdigest()[:24]
    path = f"{shared_folder(spark)}/fitted-langid-{said}"
    try:
        kept = {r.name: np.frombuffer(r.data, np.float32).reshape(tuple(r.shape)).copy() for r in spark.read.parquet(path).collect()}  # a dozen arrays
        return said, Network(sorted(NAMES), kept)
    except AnalysisException:
        network = Network(sorted(NAMES), {k: v.copy() for k, v in before[1].p.items()}) if before else Network.new(sorted(NAMES))
    network.train(*examples(counts, network.languages), steps, seed)
    arrays = [(k, v.astype(np.float32).tobytes(), list(v.shape)) for k, v in network.p.items()]
    spark.createDataFrame(arrays, "name string, data binary, shape array<int>").coalesce(1).write.mode("overwrite").parquet(path)
    return said, network


def fit_once(spark: SparkSession, rows: DataFrame | list[tuple[str, str]]) -> Model:
    """The model fitted on all rows: text, code, of which some are labelled wrongly. They are read twice."""
    texts = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "text string, code string")
    counts = counted(texts)
    first = _trained(spark, counts, STEPS, 1)
    counts = counted(texts, Model(first[1]).prepare(_common(counts)))
    return Model(_trained(spark, counts, AGAIN, 2, first)[1]).prepare(_common(counts))


def _common(counts: list[tuple[str, str | None, int]]) -> list[str]:
    return sorted({r for _, r, _ in counts if r is not None})


def code_column(label: Column) -> Column:
    """code_of as a column; null where it gives None or '?'."""
    table = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    low = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, r"^([^-_ (]+)", 1)))


def labelled(sources: list[DataFrame]) -> DataFrame:
    """code, text of every labelled text that is not blank. sources: frames of id, text, lang."""
    rows = None
    for x in sources:
        one = x.withColumn("code", code_column(F.col("lang"))).where("code is not null and trim(text) <> ''").select("code", "text")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def texts_once(sources: list[DataFrame]) -> DataFrame:
    """text, code: every labelled text, whole. sources: frames of id, text, lang.

    A wording counts once for each language it is labelled with, however many ids have it.
    """
    return once(labelled(sources).withColumn("h", F.xxhash64(wording(F.col("text")))))


def once(rows: DataFrame) -> DataFrame:
    """text, code: one text of each wording and code. rows: code, text, h, the wording's hash."""
    return rows.groupBy("code", "h").agg(F.min("text").alias("text")).select("text", "code")


def sample(sources: list[DataFrame], size: int) -> list[tuple[str, str]]:
    """At most size (text, code) rows of each language, of least hash; for trials: fit_once takes all rows."""
    from pyspark.sql import Window

    order = Window.partitionBy("code").orderBy(F.xxhash64("text"), "text")
    rows = texts_once(sources).withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)
    return sorted((r["text"], r["code"]) for r in rows.collect())


# ---- texts -----------------------------------------------------------------------------------------------------


def sentences(text: str, near: bool = False) -> list[str]:
    """The pieces of a text between its ends of sentences, after an end mark and what closes with it, and its lines that a sign begins.

    near: whether it is known to hold no character that _FAR looks for.
    """
    if near or _WIDE_STOP.search(text) is None:
        cut = _STOP.split(text)
        pieces = [a + mark if mark else a for a, mark in zip(cut[::2], cut[1::2])] if len(cut) > 1 else []
        return [s for s in [*pieces, cut[-1]] if s and not s.isspace()]
    out, at = [], 0
    for m in _ANY_STOP.finditer(text):
        a, b = m.span(m.lastindex)
        out.append(text[at:a])
        at = b
    return [s for s in [*out, text[at:]] if s and not s.isspace()]


def label_texts(model: Model, texts: list[str | None], labels: list[str | None] | None = None) -> list[tuple[str | None, float, list[tuple[int, str, float]]]]:
    """Of each text: its language, confidence, and (block, language, confidence) of every block of running text.

    The language of a text is the one of most of its running text, in characters, of which the wide ones count more.
    """
    units: list[str] = []
    sizes: list[float] = []  # characters of each unit
    firsts: list[int] = []  # first unit of each chosen block
    numbers: list[int] = []  # block number, -1 where the text has no running text
    starts: list[int] = []  # first chosen block of each text
    for t in texts:
        starts.append(len(firsts))
        if not t or not t.strip():
            continue
        found, near = blocks(t), _near(t)
        chosen = [b for b in found if b.kind == RUNNING]
        running = bool(chosen)
        if not running:
            chosen = [b for b in found if b.kind in ("quote", "heading", "list")] or [b for b in found if b.kind in ("front", "table")]
        for b in chosen:
            own = sentences(t[b.start : b.end], near)
            if own:
                firsts.append(len(units))
                numbers.append(b.no if running else -1)
                units += own
                sizes += map(len, own) if near else [len(u) + 1.5 * len(_WIDE.findall(u)) for u in own]
    langs, n = model.network.languages, len(model.network.languages)
    if not units:
        return [(None, 0.0, []) for _ in texts]
    scores = model.score(units)
    pair = np.partition(scores, -2, axis=1)[:, -2:]
    sure = (pair[:, 1] - pair[:, 0]) > MARGIN
    pick = scores.argmax(1)
    size = np.array(sizes, np.float64)
    ends = np.array([*firsts[1:], len(units)])
    block_of = np.repeat(np.arange(len(firsts)), ends - np.array(firsts))
    nb = len(firsts)
    totals = np.add.reduceat(scores, firsts, axis=0)
    cell = block_of[sure] * n + pick[sure]
    votes = np.bincount(cell, minlength=nb * n).reshape(nb, n)
    chars = np.bincount(cell, weights=size[sure], minlength=nb * n).reshape(nb, n)
    best = np.where(votes == votes.max(1, keepdims=True), totals, -np.inf).argmax(1)
    mine = sure & (pick == best[block_of])
    own = np.add.reduceat(scores * mine[:, None], firsts, axis=0)
    z = np.exp(totals - totals.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    count, row = votes.sum(1), np.arange(nb)
    share = np.where((count > 0) & (count > votes[row, best]), votes[row, best] / np.maximum(count, 1), z[row, best])
    said_something = totals.any(1)
    # of each text that has blocks
    starts.append(nb)
    has = [i for i, (a, b) in enumerate(zip(starts, starts[1:])) if a < b]
    begin = [starts[i] for i in has]
    text_chars, pooled = np.add.reduceat(chars, begin, axis=0), np.add.reduceat(totals, begin, axis=0)
    top, line = text_chars.max(1), np.arange(len(has))
    kept_k = np.where(top[:, None] == 0, pooled, np.where(text_chars == top[:, None], pooled, -np.inf)).argmax(1)
    codes = {label: code_of(label) for label in set(labels)} if labels else {}
    said = np.array([langs.index(c) if labels and (c := codes[labels[i]]) in langs else -1 for i in has])
    kept_k = np.where((said >= 0) & (pooled[line, kept_k] - pooled[line, said] < DOUBT), said, kept_k)
    p = np.exp(pooled - pooled.max(1, keepdims=True))
    part = np.where(top > 0, text_chars[line, kept_k] / np.where(top > 0, text_chars.sum(1), 1), 1.0)
    part = np.where(part >= 1, p[line, kept_k] / p.sum(1), part).tolist()
    # a block is in another language only where its own sentences say so clearly
    k_of = np.repeat(kept_k, np.diff(begin, append=nb))
    block_lang = np.where(own[row, best] - own[row, k_of] > EVIDENCE, best, k_of).tolist()
    some, share, kept_k = said_something.tolist(), share.tolist(), kept_k.tolist()
    out: list[tuple[str | None, float, list[tuple[int, str, float]]]] = [(None, 0.0, []) for _ in texts]
    for x, i in enumerate(has):
        a, b = starts[i], starts[i + 1]
        if any(some[a:b]):
            out[i] = (langs[kept_k[x]], part[x], [(numbers[j], langs[block_lang[j]], share[j]) for j in range(a, b) if numbers[j] >= 0 and some[j]])
    return out


SEGMENTS = "origin string, item_id string, block_no int, label string, lang string, confidence double"


def segments(items: DataFrame, model: Model) -> DataFrame:
    """origin, item_id, block_no, label, lang, confidence: a row of block -1 for each text, one for each running block.

    items: origin, item_id, text, label. The model (some 10,000 weights) is sent to the executors.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for origin, item, label, (lang, sure, found) in zip(b["origin"], b["item_id"], b["label"], label_texts(m, b["text"].tolist(), b["label"].tolist())):
                if lang is not None:
                    rows.append((origin, item, -1, label, lang, sure))
                    rows += [(origin, item, no, label, x, s) for no, x, s in found]
            yield pd.DataFrame(rows, columns=["origin", "item_id", "block_no", "label", "lang", "confidence"])

    return items.select("origin", "item_id", "text", "label").where("trim(text) <> ''").mapInPandas(run, SEGMENTS)


FOUND = "origin string, item_id string, block_no int, lang string, text string"


def wrong_labels(items: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The texts without a right label (block -1) and the blocks in another language than most of their text."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            labelled = label_texts(m, b["text"].tolist(), b["label"].tolist())
            for origin, item, text, label, (lang, _, found) in zip(b["origin"], b["item_id"], b["text"], b["label"], labelled):
                if lang is None:
                    continue
                kept = text if keep_text and origin == "document" else None
                if code_of(label) != lang:
                    rows.append((origin, item, -1, lang, kept))
                rows += [(origin, item, no, x, kept) for no, x, _ in found if x != lang]
            yield pd.DataFrame(rows, columns=["origin", "item_id", "block_no", "lang", "text"])

    return items.select("origin", "item_id", "text", "label").where("trim(text) <> ''").mapInPandas(run, FOUND)

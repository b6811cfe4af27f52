"""Sentences of running text, across languages and scripts, with their positions.

Spaced scripts: the places after terminators are nodes of a lattice; every span between two nodes is an arc, scored by
how well it begins and ends and by whether its brackets and quotations close; the best path gives the sentences.
Spaceless scripts with sentence marks use the same lattice, over their own marks. Scripts that only set blanks between
sentences (Thai) are cut into words by a lattice over a dictionary of words, and each blank is classified by the word
that ends before it and the word that opens after it: a blank parts sentences where the left word is one that ends
texts and the right word one that begins them. The dictionary and these counts are learned from all texts.

Only running text counts (see blocks). Null, empty and blank texts and texts without running text give nothing.
Positions count characters from 0, end exclusive, without surrounding white space.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import RUNNING, blocks

WORDS = 50_000  # most frequent words of the dictionary
KEYS = 100_000  # most frequent words whose places at edges are kept
LONGEST = 16  # characters of a dictionary word
ROUNDS = 2  # times that the runs are read to prune the dictionary
PRIOR = 0.15  # such a share of a word of which little is known
RARE = 0.02  # share of texts' edges below which a word neither ends nor opens a sentence
REACH = 14  # nodes that an arc may pass

#: Abbreviations that never end a sentence: titles, references and times (fixed values).
NEVER = frozenset(
    "dr dra drs mr mrs ms prof dott dottssa sig sra sr hr fr st mme mlle mons ing "
    "p pp pag pág págs fig figs abb bd vol vols nr no núm nº cap ch kap art sec s vgl cf cfr ср см стр рис ca env ed hrsg z bzw d.h "
    "т тт гл г-н г-жа им ул д-р डॉ पृ सं د ص مج أ ดร นพ".split()
)
#: Abbreviations that end a sentence only where the next word opens one (fixed values).
MAYBE = frozenset("etc ecc usw u.a inc ltd co jr sr г гг д др пр н.э a.m p.m am pm m إلخ الخ ฯลฯ น".split())

#: Months after a day's ordinal number, and words before one (fixed values).
_MONTH = re.compile(r"(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|januar|februar|mars|april|mai|juni|juli|august)", re.I)
_DATED = re.compile(r"(?:^|\s)(?:am|vom|zum|bis|den|dem|der|im)\s+\d{1,2}$", re.I)
_MARK = re.compile(r"[.!?…]+|[。！？।؟۔]+|…+")
_CLOSE = "\"”’»›)]}」』）】〉》’'"
_OPEN = "\"“‘«‹([{「『（【〈《„‚¿¡"
_PAIR = {"(": ")", "[": "]", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "„": "“", "‘": "’", "《": "》", "【": "】"}
_ENDS = {v: k for k, v in _PAIR.items() if v != "“"}
_THAI = re.compile(r"[฀-๿]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_UNICASE = re.compile(r"[֐-ۿऀ-෿฀-๿]")
_PIECE = re.compile(r"\S+")


# ---- dictionary and word lattice ---------------------------------------------------------------------------------

_RUN = re.compile(r"[฀-๿]+")
_FOLLOWS = frozenset("ะัาำิีึืฺุูๅ็่้๊๋์ํ๎ๆฯ")
_LEADS = frozenset("เแโใไ")


@dataclass
class Lexicon:
    """Word costs, and how often words begin and end texts or stand beside blanks."""

    cost: dict[str, float] = field(default_factory=dict)
    longest: int = 1
    opens: Counter = field(default_factory=Counter)
    ends: Counter = field(default_factory=Counter)
    after: Counter = field(default_factory=Counter)
    before: Counter = field(default_factory=Counter)

    def words(self, run: str) -> list[str]:
        """The cheapest path through the lattice of dictionary words; unknown characters stand alone."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == math.inf:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = self.cost.get(run[i:j], 14.0 if j == i + 1 else None)
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]

    @classmethod
    def of(cls, words: dict[str, int]) -> "Lexicon":
        """A dictionary of counted words: each costs the logarithm of its rarity."""
        total = sum(words.values()) or 1
        return cls({w: math.log(total / c) + 1 for w, c in words.items()}, max((len(w) for w in words), default=1))

    def opening(self, piece: str) -> str:
        """The key of the word that opens a piece between blanks."""
        if m := _RUN.match(piece):
            return self.words(m.group())[0]
        return _shape(piece, piece)

    def ending(self, piece: str) -> str:
        """The key of the word that ends a piece between blanks."""
        runs = list(_RUN.finditer(piece))
        if runs and runs[-1].end() == len(piece):
            return self.words(runs[-1].group())[-1]
        return _shape(piece, piece[-1:] if not piece[-1:].isalnum() else piece)

    def rate(self, here: Counter, beside: Counter, key: str) -> float | None:
        """The share of a word's places that are texts' edges; None where too few are known."""
        n = here[key] + beside[key]
        return (here[key] + 3 * PRIOR) / (n + 3) if n >= 6 else None


def _shape(piece: str, mark: str) -> str:
    """Foreign words and numbers by their form, other words as they are."""
    if re.fullmatch(r"[A-Z]\.", piece):
        return "<initial>"
    if mark == "." and re.fullmatch(r"[^\W\d_A-Za-z][\w\u0e00-\u0e7f]*\.", piece):
        return piece
    if mark and not mark[0].isalnum():
        return mark[0]
    if re.fullmatch(r"[\d.,:]+", piece):
        return "<number>"
    if re.search(r"\d", piece):
        return "<code>"
    if re.match(r"[A-Za-zÀ-ɏ]", piece):
        return "<name>"
    return piece


#: Words that never open a Thai sentence, and particles that end one (fixed values), where counts are few.
THAI_WITHIN = ("และ", "หรือ", "ที่", "ของ", "มี", "เป็น", "ถาม", "เขียน", "สำหรับ", "เกี่ยวกับ", "ตาม", "ว่า", "ซึ่ง", "โดย", "ใน", "แต่", "ฯลฯ", "เล่ม", "หน้า", "ยูโร", "น.")
THAI_FINAL = ("ครับ", "ค่ะ", "คะ", "นะ", "แล้ว", "ไหม", "หรือยัง", "ฯลฯ", "เถอะ", "จ้ะ")


def _thai(text: str, start: int, end: int, lex: Lexicon) -> list[tuple[int, int]]:
    """One pass over the pieces between blanks, with the depth of open brackets; each gap is classified by its words."""
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, start, end)]
    out: list[tuple[int, int]] = []
    at, depth = start, 0
    for (a, b), (a2, b2) in zip(pieces, pieces[1:]):
        left = text[a:b]
        depth += sum(map(left.count, "(“[")) - sum(map(left.count, ")”]"))
        if depth > 0:
            continue
        right = text[a2:b2]
        l, r = lex.ending(left), lex.opening(right)
        if l == "<initial>" or (l == "<name>" and r == "<name>"):
            continue
        pe, po = lex.rate(lex.ends, lex.before, l), lex.rate(lex.opens, lex.after, r)
        if pe is None:
            pe = 0.0 if left.endswith(("”", ".")) or l == "<name>" else 0.3 if l in THAI_FINAL else PRIOR
        if po is None:
            po = 0.0 if right.startswith(THAI_WITHIN) or r in ("<number>", "<code>") else PRIOR
        if pe > RARE and (po > RARE or right[0] in "(“"):
            out.append((at, b))
            at = a2
    if pieces:
        out.append((at, pieces[-1][1]))
    return out


# ---- lattice of terminators --------------------------------------------------------------------------------------


def _nodes(body: str, lex: Lexicon) -> list[tuple[int, int, float]]:
    """(end, next start, score) of each place where a sentence may end."""
    out = []
    n = len(body)
    for m in _MARK.finditer(body):
        end = m.end()
        while end < n and body[end] in _CLOSE and not (body[end] in "\"'’" and end + 1 < n and body[end + 1].isalnum()):
            end += 1
        spaced = end  # French sets a blank before the closing mark
        if body[end : end + 2] in (" »", " »", " »"):
            end = spaced = end + 2
        nxt = end
        while nxt < n and body[nxt].isspace():
            nxt += 1
        wide = body[m.start()] in "。！？।؟۔" or (body[m.start()] == "…" and m.start() and _WIDE.match(body[m.start() - 1]))
        if nxt >= n:
            continue
        if nxt == end and not wide:
            continue
        closed = body[m.end() : end].strip()
        quoted = bool(re.search(r"[\"”’»」』“]", closed))
        following = body[nxt]
        if quoted and body[m.start() : m.end()] and following in "—–-,;:":
            continue
        stop = m.start()
        before = body[max(0, stop - 40) : stop]
        at = stop
        while at and not body[at - 1].isspace():
            at -= 1
        token = body[at:stop].lstrip(_OPEN)
        lower = token.lower()
        score = 2.0
        unicase = _UNICASE.match(following) is not None or _WIDE.match(following) is not None
        if body[m.start()] == "." and m.end() - m.start() == 1 and not wide:
            short = lower.rsplit(".", 1)[-1]
            if _DEVANAGARI.search(before[-3:]):
                score = -4.0
            elif len(token) == 1 and token.isalpha() and (token.isupper() or lower in NEVER):
                score = -4.0
            elif not closed and (lower in NEVER or short in NEVER):
                score = -4.0
            elif lower in MAYBE or short in MAYBE:
                if unicase:
                    rate = lex.rate(lex.opens, lex.after, lex.opening(body[nxt:].split()[0]))
                    score = -2.0 if (rate is not None and rate < 0.02) or (rate is None and lower in ("إلخ", "الخ")) else 1.0
                else:
                    score = 1.0
            elif following.isdigit():
                score = -1.0 if len(token) <= 3 else 1.0
            elif re.fullmatch(r"\d{1,2}", token) and (_MONTH.match(body, nxt) or _DATED.search(before)):
                score = -4.0
        elif body[m.start()] == "…" and not wide and following.islower():
            score = -3.0
        if following.islower():
            score = -4.0
        elif quoted and not wide and unicase:
            score = -4.0  # the words that frame a quotation follow it
        elif quoted and (wide or _WIDE.match(before[-1:] or " ") or _DEVANAGARI.search(before[-2:]) or _ARABIC.search(before[-2:])):
            score = -4.0
        elif quoted and _UNICASE.search(before[-12:]):
            score = -4.0
        elif following in ",;:)]}":
            score = -4.0
        out.append((end, nxt, score))
    return out


_DEVANAGARI = re.compile(r"[ऀ-ॣ॰-ॿ]")
_ARABIC = re.compile(r"[؀-ۿ]")


def _open_marks(body: str, marks: list[tuple[int, str]], start: int) -> int:
    """How many brackets and quotations a span leaves open, or closes without having opened them.

    marks: the span's brackets and quotation marks with their places; start: where the span begins.
    """
    stack: list[str] = []
    bad = 0
    german = False
    for i, ch in marks:
        german = german or ch == "„"
        if ch == "“" and german and "„" in stack:
            stack.remove("„")
        elif ch in _PAIR:
            stack.append(ch)
        elif _ENDS[ch] in stack:
            stack.remove(_ENDS[ch])
        elif not (ch == ")" and start < i < start + 4 and body[i - 1].isalnum()):
            bad += 1
    return len(stack) + bad


_BRACKET = re.compile("[" + re.escape("".join(c for c in {*_PAIR, *_ENDS} if c not in "‘’")) + "]")


def _inside(body: str) -> list[tuple[int, int]]:
    """The outermost stretches between a quotation mark or bracket and the one that closes it, in order."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(body):
        ch, i = m.group(), m.start()
        if ch == "“" and any(o == "„" for o, _ in stack):
            opener = "„"
        elif ch in _PAIR:
            stack.append((ch, i))
            continue
        else:
            opener = _ENDS[ch]
        at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == opener), None)
        if at is not None:
            first = stack[at][1]
            del stack[at:]
            while out and out[-1][0] > first:
                out.pop()
            out.append((first, i))
    return out


def _within(stretches: list[tuple[int, int]], at: int) -> bool:
    k = bisect_left(stretches, (at,)) - 1
    return k >= 0 and at <= stretches[k][1]


def _lattice(text: str, start: int, end: int, lex: Lexicon) -> list[tuple[int, int]]:
    body = text[start:end]
    inner = _inside(body)
    nodes = [(0, 0, 0.0), *(n for n in _nodes(body, lex) if not _within(inner, n[0])), (len(body), len(body), 3.0)]
    k = len(nodes)
    best, back = [0.0] + [-math.inf] * (k - 1), [0] * k
    brackets = [(m.start(), m.group()) for m in _BRACKET.finditer(body)]
    places = [i for i, _ in brackets]
    for j in range(1, k):
        last = bisect_left(places, nodes[j][0])
        passed = 0.0
        for i in range(j - 1, max(-1, j - 1 - REACH), -1):
            if best[i] > -math.inf:
                at = nodes[i][1]
                first = bisect_left(places, at) if places else 0
                marks = _open_marks(body, brackets[first:last], at) if first < last else 0
                value = best[i] + nodes[j][2] - 3.0 * marks - passed
                if value > best[j]:
                    best[j], back[j] = value, i
            if i:
                passed += max(nodes[i][2], 0.0) * 0.5  # a good place that the arc passes by
    if best[-1] == -math.inf:
        return [(start, end)]
    path, j = [], k - 1
    while j:
        path.append((start + nodes[back[j]][1], start + nodes[j][0]))
        j = back[j]
    return path[::-1]


def sentences(text: str | None, lex: Lexicon) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the running text."""
    if not text or not text.strip():
        return []
    out = []
    for b in blocks(text):
        if b.kind != RUNNING:
            continue
        body = text[b.start : b.end]
        thai = len(_THAI.findall(body))
        spans = _thai(text, b.start, b.end, lex) if thai * 3 > len(re.findall(r"[^\W\d_]", body)) else _lattice(text, b.start, b.end, lex)
        for s, e in spans:
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s and re.search(r"\w", text[s:e]):
                out.append((s, e))
    return out


# ---- operator ----------------------------------------------------------------------------------------------------


def _counted(rows: DataFrame, count: Callable[[Iterator[pd.DataFrame]], Iterator[Counter]], keys: list[str]) -> DataFrame:
    """keys and n: what count finds in the rows, combined in the workers and then over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in count(batches):
            out = pd.DataFrame(list(c), columns=keys) if c else pd.DataFrame({k: pd.Series(dtype=object) for k in keys})
            out["n"] = list(c.values())
            yield out.astype({"n": "int64"})

    counted = rows.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", n bigint")
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"))


HELD = 200_000  # entries of a worker's counter before it is passed on


def _thai_runs(texts: DataFrame) -> DataFrame:
    """run, n: the runs of Thai letters of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[Counter]:
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update((r,) for r in _RUN.findall(t))
            if len(c) > HELD:
                yield c
                c = Counter()
        yield c

    return _counted(texts, count, ["run"])


def candidates(runs: DataFrame) -> DataFrame:
    """word, n: substrings of the runs that at least two different characters precede and two follow, and whole runs."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[tuple[str, str, str], int] = {}
            for r, k in zip(b["run"], b["n"].tolist()):
                n = len(r)
                for i in range(n):
                    if r[i] in _FOLLOWS:
                        continue
                    for j in range(i + 1, min(n, i + LONGEST) + 1):
                        if r[j - 1] in _LEADS or (j < n and r[j] in _FOLLOWS) or (j == i + 1 and n > 1):
                            continue
                        key = r[i:j], r[i - 1] if i else " ", r[j] if j < n else " "
                        rows[key] = rows.get(key, 0) + k
                if len(rows) > HELD:
                    yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["word", "l", "r", "n"])
                    rows = {}
            yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["word", "l", "r", "n"]).astype({"n": "int64"})

    parts = runs.mapInPandas(cut_up, "word string, l string, r string, n bigint")
    # the characters beside a word are those of one script: these sets are small
    words = parts.groupBy("word").agg(F.sum("n").alias("n"), F.size(F.collect_set("l")).alias("lefts"), F.size(F.collect_set("r")).alias("rights"))
    inner = words.where("n >= 3 and lefts >= 2 and rights >= 2 and length(word) >= 2").select("word", "n")
    whole = runs.where(f"n >= 3 and length(run) <= {LONGEST}").select(F.col("run").alias("word"), "n")
    return inner.unionByName(whole).groupBy("word").agg(F.max("n").alias("n"))


def _most(words: DataFrame, bound: int) -> dict[str, int]:
    """At most bound words, the most frequent ones."""
    return {r.word: r.n for r in words.orderBy(F.desc("n"), "word").limit(bound).collect()}


def dictionary(texts: DataFrame) -> Lexicon:
    """The dictionary of the texts' spaceless words: candidates counted over all texts, pruned by reading the runs with them."""
    from ..session import cut

    runs = cut(_thai_runs(texts))
    words = _most(candidates(runs), 4 * WORDS)
    for _ in range(ROUNDS):
        lex = runs.sparkSession.sparkContext.broadcast(Lexicon.of(words))

        def read(batches: Iterator[pd.DataFrame], lex: Broadcast = lex) -> Iterator[Counter]:
            for b in batches:
                c: Counter = Counter()
                for r, n in zip(b["run"], b["n"].tolist()):
                    for w in lex.value.words(r):
                        c[w,] += n
                yield c

        words = _most(_counted(runs, read, ["word"]).where("n >= 2").where(~F.col("word").isin(list(_FOLLOWS))), WORDS)
    return Lexicon.of(words)


def _edges(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """kind, a, z, n: the words that open and end the blocks of all texts, and the pairs beside each gap."""
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[Counter]:
        known = shared.value
        ending, opening = lru_cache(HELD)(known.ending), lru_cache(HELD)(known.opening)
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                for block in blocks(t):
                    if block.kind != RUNNING:
                        continue
                    body = t[block.start : block.end]
                    if not _UNICASE.search(body):
                        continue
                    pieces = body.split()
                    c["open", opening(pieces[0]), ""] += 1
                    c["end", ending(pieces[-1]), ""] += 1
                    c.update(("gap", ending(a), opening(z)) for a, z in zip(pieces, pieces[1:]))
            if len(c) > HELD:
                yield c
                c = Counter()
        yield c

    return _counted(texts, count, ["kind", "a", "z"])


def learn(items: DataFrame) -> Lexicon:
    """The lexicon of all texts that have scripts without case.

    Runs, candidates, edges and gaps are counted over all of them; only the dictionary (WORDS entries at most) and the
    edge counts of frequent words (KEYS entries of each kind at most) come to the driver and to the workers. Rarer words
    are treated as unknown ones.
    """
    from ..session import cut

    texts = items.where("text is not null").select("text").where(F.col("text").rlike("[\\u0590-\\u06ff\\u0900-\\u0dff\\u0e00-\\u0e7f]")).distinct()  # copies teach once; they are combined before the shuffle
    texts = cut(texts)
    lex = dictionary(texts.where(F.col("text").rlike("[\\u0e00-\\u0e7f]")))
    seen = cut(_edges(texts, lex))
    gaps = seen.where("kind = 'gap' and not (z = '<name>' and a in ('<name>', '<initial>'))")
    opens, ends = (seen.where(F.col("kind") == k).select(F.col("a").alias("word"), F.col("n").alias("here")) for k in ("open", "end"))

    def rate(here: DataFrame, beside: DataFrame) -> DataFrame:
        """The words that are an edge often enough."""
        both = beside.join(here, "word", "left").na.fill(0, ["here"])
        return both.where("n + here >= 6").withColumn("rate", (F.col("here") + 3 * PRIOR) / (F.col("n") + F.col("here") + 3))

    after = gaps.groupBy(F.col("z").alias("word")).agg(F.sum("n").alias("n"))
    before = gaps.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    # once more, counting a word only beside words that let a sentence end or begin there
    may_end = rate(ends, before).where(F.col("rate") > RARE).select(F.col("word").alias("a"), F.lit(True).alias("ends"))
    may_open = rate(opens, after).where(F.col("rate") > RARE / 2).select(F.col("word").alias("z"), F.lit(True).alias("opens"))
    gaps = gaps.join(may_end, "a", "left").join(may_open, "z", "left").na.fill(False, ["ends", "opens"])
    after = gaps.where("ends or not opens").groupBy(F.col("z").alias("word")).agg(F.sum("n").alias("n"))
    before = gaps.where("opens or not ends").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    parts = [d.select(F.lit(k).alias("part"), "word", "n") for k, d in (("opens", opens.withColumnRenamed("here", "n")), ("ends", ends.withColumnRenamed("here", "n")), ("after", after), ("before", before))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    ranked = every.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "word"))).where(F.col("k") <= KEYS)
    for r in ranked.select("part", "word", "n").collect():
        getattr(lex, r.part)[r.word] = r.n
    return lex


def split(items: DataFrame, lex: Lexicon, keep_text: bool = True) -> DataFrame:
    """origin, item_id, start_pos, end_pos, and sentence if kept, of each item (origin, item_id, text). No shuffle."""
    shared = items.sparkSession.sparkContext.broadcast(lex)
    columns = ["origin", "item_id", "start_pos", "end_pos", *["sentence"] * keep_text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = [(o, i, s, e, *[t[s:e]] * keep_text) for o, i, t in b.itertuples(index=False) for s, e in sentences(t, known)]
            yield pd.DataFrame(rows, columns=columns)

    rows = items.select("origin", "item_id", "text").where("text is not null")
    return rows.mapInPandas(run, "origin string, item_id string, start_pos int, end_pos int" + ", sentence string" * keep_text)

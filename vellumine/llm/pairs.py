"""Defects of prompt and response pairs, by alignment.

A response is aligned with its prompt and with refusal templates. Copies: shingle containment in both directions finds
the candidates, the longest common subsequence of tokens confirms them; a copy aligns with the whole source, its passage
or its question. Refusals: sentences aligned with templates that have slots, in whatever language (see refusals). The
language of a response is found by the language network (see langid) and compared with the one the source asks for;
an answer breaks off where it has no end of its own, judged by its last mark, by the prompt's text that it follows and
by sounder answers of the same pair.

Null, empty and blank answers and answers of signs alone are empty; an answer has at most one defect, in the order
empty, refusal, copy, language, truncated. A null source makes only empty and refusal decidable; a null or empty list
of responses gives only the row of expected; repeated rows count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .langid import NAMES, Model
from .refusals import is_refusal
from .sentences import MAYBE, NEVER

TOKENS = 3  # tokens of a copy's shingle
COPY = 0.9  # least common subsequence of a copy, as a share of the longer side
ODDS = 4.0  # log-odds by which an answer is in another language than asked for

#: Answers that stand for nothing (fixed values).
NOTHING = frozenset("null none nil nan undefined n/a na n.a empty (empty) [empty] void blank missing no-answer (none) vacío leer vide vuoto vazio пусто 空 无 なし ... … - -- — . ? ! * _".split())

_LANGUAGE = {name: code for code, names in NAMES.items() for name in names.split() if len(name) > 3 or not name.isascii()}
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[฀-๿]|[^\W_]+")
_FENCE = re.compile(r"^\s*(?:```+|~~~+)[\w-]*[ \t]*\n?|\n?\s*(?:```+|~~~+)\s*$")
_END = re.compile(r"[.!?。！？।؟۔]+[\s\"'”’»›)\]}」』）】]*$")
_DOTS = re.compile(r"(?:…+|\.{3,})[\s\"'”’»›)\]}」』）】]*$")


def bare(answer: str) -> str:
    """An answer without the formatting around it."""
    s = answer.replace("​", "").replace("﻿", "").strip()
    for _ in range(3):
        t = _FENCE.sub("", s).strip()
        t = re.sub(r"(?m)^\s*>\s?", "", t)
        t = re.sub(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+(?=\S)", "", t) if re.match(r"\s*(?:[-*+]|\d+[.)])\s+\S", t) else t
        t = re.sub(r"^(\*\*|__|\*|_|`+)(.+?)\1$", r"\2", t, flags=re.S).strip()
        if t == s:
            break
        s = t
    return s


def tokens(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = html.unescape(re.sub(r"<[^<>]*>", "", answer)).replace("​", "").replace("﻿", "")
    s = re.sub(r"```\w*|~~~\w*", "", s).strip()
    return not s or not re.search(r"\w", s) or bare(s).strip("*_`\"' ").lower() in NOTHING


def shingles(seq: str | list[str], n: int) -> Counter:
    if len(seq) < n:
        return Counter([tuple(seq)])
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def containment(a: Counter, b: Counter) -> float:
    """The share of a that b holds."""
    total = sum(a.values())
    return sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        m = row & at.get(y, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def parts(source: str, mode: str) -> tuple[str, str, list[str]]:
    """(instruction, passage, questions) of a source."""
    ps = [p.strip() for p in re.split(r"\n\s*\n", source.strip()) if p.strip()]
    if not ps:
        return "", "", []
    if mode != "question":
        return ps[0], "\n\n".join(ps[1:]), []
    ends = re.compile(r"[?？؟]\s*$")
    if ends.search(ps[0]) and len(ps) > 1:
        return "", "\n\n".join(ps[1:]), [ps[0]]
    if len(ps) > 2 and ends.search(ps[-1]):
        return ps[0], "\n\n".join(ps[1:-1]), [ps[-1]]
    return ps[0], "\n\n".join(ps[1:]), [p for p in ps if ends.search(p)]


def translatable(passage: str) -> bool:
    """Whether a passage has words beside names, numbers, codes and addresses."""
    s = re.sub(r"https?://\S+|\S+@\S+", " ", passage)
    s = re.sub(r"(?<!\w)[^\W\d_]{1,4}\.\s*(?=\d)", " ", s)
    s = re.sub(r"\S*\d\S*", " ", s)
    if re.search(r"[぀-ヿ㐀-鿿฀-๿ऀ-ॿ؀-ۿ]", s):
        return True
    words = s.split()
    if any(w[:1].islower() and len(w.strip(".,;:")) > 1 for w in words):
        return True
    return len(words) > 3 and bool(re.search(r"[.!?]$", s.strip()))


def is_copy(answer: str, source: str, passage: str, questions: list[str], mode: str) -> bool:
    a = tokens(bare(answer))
    if not a:
        return False
    whole = tokens(source)
    options = [whole, tokens(passage)]
    if mode == "question":
        ps = [p for p in re.split(r"\n\s*\n", source.strip()) if p.strip()]
        options += [tokens("\n".join(ps[1:])), tokens("\n".join(ps[:-1]))] + [tokens(q) for q in questions]
    mine = shingles(a, TOKENS)
    for o in options:
        if not o:
            continue
        theirs = shingles(o, TOKENS)
        if min(containment(mine, theirs), containment(theirs, mine)) >= 0.75 and common(a, o) / max(len(a), len(o)) >= COPY:
            return True
    return False


def asked_language(instruction: str) -> str | None:
    """The language that a translation's instruction names."""
    for w in re.findall(r"[^\W\d_]+", instruction.lower()):
        if w in _LANGUAGE:
            return _LANGUAGE[w]
    return next((c for n, c in _LANGUAGE.items() if not n.isascii() and n in instruction.lower()), None)


def is_truncated(answer: str, mode: str, passage: str, questions: list[str], others: list[str], target: str | None) -> bool:
    s = bare(answer)
    source_end = passage.rstrip(" \n\"'”’»›)]}」』）】*_`")
    if _DOTS.search(s):
        if mode == "question":
            core = tokens(_DOTS.sub("", s))
            text = tokens(passage)
            at = _place(core, text)
            return at is None or not re.search(re.escape(core[-1]) + r"[^\w]*(?:…|\.\.\.)", passage.lower()) if core else True
        last = re.search(r"([^\W\d_]+)\.?$", source_end)
        listing = bool(last and last.group(1).lower() in MAYBE | {"etc", "ecc", "usw", "д"}) or source_end.endswith(("等", "など", "等等"))
        return not (source_end.endswith(("…", "...")) or (listing and target in ("zh", "ja", "th", "ko")))
    if _END.search(s):
        if s.rstrip("\"'”’»›)]}」』）】 ").endswith("."):
            m = re.search(r"(?:^|[\s(])([^\s()]+)\.[\"'”’»)\]]*$", s)
            w = m.group(1).lower() if m else ""
            if w and (w in NEVER or (len(w) == 1 and w.isalpha() and w not in MAYBE)) and not re.search(re.escape(w) + r"\.$", source_end.lower()):
                return True
        whole = tokens(passage)
        mine = tokens(s)
        if mode == "review_content" and len(mine) < 0.9 * len(whole) and common(mine, whole[: len(mine)]) >= 0.9 * len(mine):
            return True
        if mode == "translation":
            return any(len(mine) < 0.9 * len(o) and o[: len(mine)] == mine for o in (tokens(o) for o in others if _END.search(bare(o))))
        return False
    if target == "th" and mode != "question":
        mine, best = tokens(s), [tokens(o) for o in others]
        return any(len(mine) < 0.9 * len(o) and o[: len(mine)] == mine for o in best)
    if mode != "question":
        return bool(_END.search(source_end) or _DOTS.search(source_end) or len(tokens(s)) < 0.9 * len(tokens(passage)) and mode == "review_content")
    core = tokens(s)
    if not core:
        return False
    if any(tokens(bare(o)) == core and _END.search(bare(o)) for o in others):
        return False
    return not stands_whole(core, passage, {w for q in questions for w in tokens(q)})


def stands_whole(core: list[str], passage: str, asked: set[str]) -> bool:
    """Whether an answer without an end mark is a whole part of the passage.

    Such a part begins and ends at a sign, at the passage's edge, or beside a word of the question.
    """
    low = unicodedata.normalize("NFKC", passage).lower()
    at = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    text = [low[a:b] for a, b in at]
    for i in _place(core, text) or ():
        j = i + len(core)
        left = i == 0 or text[i - 1] in asked or re.search(r"[^\w\s]", low[at[i - 1][1] : at[i][0]])
        right = j == len(at) or text[j] in asked or re.search(r"[^\w\s]", low[at[j - 1][1] : at[j][0]])
        if left and right:
            return True
    return False


def _place(core: list[str], text: list[str]) -> list[int] | None:
    """Where a run of tokens stands in a text."""
    n = len(core)
    at = [i for i in range(len(text) - n + 1) if text[i : i + n] == core] if n else []
    return at or None


def judge(rows: list[tuple], model: Model) -> list[tuple[str, int, str]]:
    """(name, response_no, defect) of (name, mode, source, responses, expected) rows."""
    out: list[tuple[str, int, str]] = []
    open_: list[tuple] = []
    for name, mode, source, responses, expected in rows:
        answers = [*(enumerate(responses) if responses is not None else []), (-1, expected)]
        source = source or ""
        instruction, passage, questions = parts(source, mode or "")
        words = mode != "translation" or translatable(passage)
        for no, answer in answers:
            if is_empty(answer):
                out.append((name, no, "empty"))
            elif is_refusal(bare(answer), passage):
                out.append((name, no, "refusal"))
            elif not source or not words:
                continue
            elif mode in ("translation", "question") and is_copy(answer, source, passage, questions, mode):
                out.append((name, no, "copy"))
            else:
                others = [a for k, a in answers if k != no and a is not None]
                open_.append((name, no, mode, answer, instruction, passage, questions, others))
    if not open_:
        return out
    langs = model.network.languages
    mine = model.score([bare(x[3]) for x in open_])
    asked = model.score([f"{' '.join(x[6])} {x[5]}" for x in open_])
    for x, a, b in zip(open_, mine, asked):
        name, no, mode, answer, instruction, passage, questions, others = x
        target = asked_language(instruction) if mode == "translation" else None
        if target is None and mode != "translation" and b.any():
            target = langs[int(b.argmax())]
        if target in langs and a.any():
            k, t = int(a.argmax()), langs.index(target)
            given = tokens(bare(answer))
            text = set(tokens(passage)) if mode != "translation" else set()
            share = sum(w in text for w in given) / len(given) if given else 0.0
            if k != t and a[k] - a[t] > ODDS and share < 0.6:
                out.append((name, no, "language"))
                continue
        if is_truncated(answer, mode, passage, questions, others, target):
            out.append((name, no, "truncated"))
    return out


def defects(cases: DataFrame, model: Model) -> DataFrame:
    """name, response_no, defect of every defective answer."""
    shared = cases.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, m, s, None if r is None else list(r), e) for n, m, s, r, e in b.itertuples(index=False)]
            yield pd.DataFrame(judge(rows, shared.value), columns=["name", "response_no", "defect"])

    rows = cases.select("name", "mode", "source", "responses", "expected").where("name is not null")
    return rows.mapInPandas(run, "name string, response_no int, defect string")

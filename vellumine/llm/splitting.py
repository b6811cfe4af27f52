"""Cutting oversized items at natural boundaries, by lexical cohesion.

Every gap between two units of text (sentences, lines, blocks, chapters) is scored: the words of a sliding window of
units before it are compared with those after it, and a gap lies in a valley where that similarity is lower than at
the peaks on both sides. Within the size window of a piece the deepest valley of the strongest kind of boundary is the
cut. The next piece starts at the boundary nearest to the wished overlap before the cut.

Null and empty texts give nothing; a text within its limit is one piece; where a window has no boundary, the cut falls
between words, and within a word only where one word alone is too long. Line ends and blanks belong to the piece that
they end.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import Lexicon, sentences

BLOCK_UNITS = 3  # units on each side of a gap that are compared
CHAPTER, BLOCK, LINE, SENTENCE, WORD = 4, 3, 2, 1, 0
_CHAPTER = regex.compile(r"(?m)(?<=^|\n)(?=#{1,2} )")
_BLOCK = regex.compile(r"\n(?:[^\S\n]*\n)+(?=[^\n]|$)")
_LINE = regex.compile(r"\n+(?=[-*|>#]|\d+[.)] )")
_WORDS = regex.compile(r"[\p{L}\p{M}--[\u0e00-\u0e7f]]{3,}|\p{Han}|[\p{Hiragana}\p{Katakana}]{2}|[\u0e01-\u0e2e\u0e40-\u0e44][\u0e00-\u0e7f]{2}", regex.V1)
_PLAIN = Lexicon()  # sentence ends of other scripts need no counts; blanks of Thai are judged by its particles and opening words


def gaps(text: str) -> dict[int, int]:
    """Position of each boundary, before which a piece can end, with its kind. Sentences are those of the sentence operator."""
    found: dict[int, int] = {}
    for _, end in sentences(text, _PLAIN):
        while end < len(text) and text[end].isspace():
            end += 1
        found[end] = SENTENCE
    for kind, pattern in ((LINE, _LINE), (BLOCK, _BLOCK), (CHAPTER, _CHAPTER)):
        for m in pattern.finditer(text):
            found[m.end()] = max(kind, found.get(m.end(), 0))
    found.pop(0, None)
    found.pop(len(text), None)
    return found


def depths(text: str, at: list[int]) -> list[float]:
    """Depth of the valley at each of the ordered gaps."""
    edges = [0, *at, len(text)]
    bags = [Counter(w.lower() for w in _WORDS.findall(text[a:b])) for a, b in zip(edges, edges[1:])]
    sims = []
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[:BLOCK_UNITS + 1][1:]:
        right.update(b)
    left.update(bags[0])
    for i in range(len(at)):
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
        left.update(bags[i + 1])
        if i + 1 >= BLOCK_UNITS:
            left.subtract(bags[i + 1 - BLOCK_UNITS])
            left = +left
        right.subtract(bags[i + 1])
        right = +right
        if i + 1 + BLOCK_UNITS < len(bags):
            right.update(bags[i + 1 + BLOCK_UNITS])
    n, up, down = len(sims), [0.0] * len(sims), [0.0] * len(sims)
    for i in range(n):  # height of the peak reached by climbing to the left, then to the right
        up[i] = max(sims[i], up[i - 1]) if i and sims[i - 1] >= sims[i] else sims[i]
    for i in range(n - 1, -1, -1):
        down[i] = max(sims[i], down[i + 1]) if i + 1 < n and sims[i + 1] >= sims[i] else sims[i]
    return [up[i] + down[i] - 2 * sims[i] for i in range(n)]


def _word_cut(text: str, low: int, high: int) -> int:
    """The last place in (low, high] after white space, else high."""
    for i in range(high, low, -1):
        if text[i - 1].isspace():
            return i
    return high


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most limit characters, consecutive ones overlapping by about overlap; one that is not below the limit counts as one character less than it."""
    n = len(text)
    if n <= limit or limit <= 0:
        return [(0, n)] if n else []
    overlap = max(0, min(overlap, limit - 1))
    kinds = gaps(text)
    at = sorted(kinds)
    depth = depths(text, at)
    out, start = [], 0
    while n - start > limit:
        low, high = start + min(max(limit // 2, overlap + 1), limit - 1), start + limit
        window = range(bisect_right(at, low), bisect_right(at, high))
        strong = [i for i in window if kinds[at[i]] >= BLOCK] or [i for i in window if kinds[at[i]] == LINE] or list(window)
        if strong:
            end = at[max(strong, key=lambda i: (kinds[at[i]] == CHAPTER, round(depth[i], 9), at[i]))]
        else:
            end = _word_cut(text, low, high)
        out.append((start, end))
        wish = end - overlap
        near = [at[i] for i in range(max(0, bisect_left(at, wish) - 1), min(len(at), bisect_left(at, wish) + 1)) if start < at[i] < end and abs(at[i] - wish) <= max(overlap // 2, 1)]
        if not overlap:
            start = end
        elif near:
            start = min(near, key=lambda p: (abs(p - wish), p))
        else:
            start = max(start + 1, _word_cut(text, max(start + 1, wish - overlap // 4), max(wish, start + 2)))
    out.append((start, n))
    return out


def split_items(items: DataFrame) -> DataFrame:
    """origin, item_id, piece_no, start_pos, end_pos, piece of each item.

    items: origin, item_id, text, max_chars, overlap_chars. Rows of null or empty text give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for origin, item, text, limit, overlap in b.itertuples(index=False):
                if text:
                    rows += [(origin, item, k, s, e, text[s:e]) for k, (s, e) in enumerate(pieces(text, int(limit), int(overlap)))]
            yield pd.DataFrame(rows, columns=["origin", "item_id", "piece_no", "start_pos", "end_pos", "piece"])

    rows = items.select("origin", "item_id", "text", "max_chars", "overlap_chars").where("text is not null and max_chars is not null")
    return rows.mapInPandas(run, "origin string, item_id string, piece_no int, start_pos int, end_pos int, piece string")


def check(items: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: items and characters that went in, and how many items came out, were lost, have pieces above their limit, gaps between pieces or a wrong text.

    items: as of split_items, parts: its result.
    """
    given = items.where(F.length("text") > 0).select("origin", "item_id", "text", "max_chars").dropDuplicates(["origin", "item_id"])
    p = parts.groupBy("origin", "item_id").agg(
        F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"),
        F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p"),
    )
    x = given.join(p, ["origin", "item_id"], "full")
    holes = F.exists(F.sequence(F.lit(1), F.size("p")), lambda i: F.coalesce(F.get("p", i).start_pos > F.get("p", i - 1).end_pos, F.lit(False)))
    ends = (F.get("p", F.lit(0)).start_pos != 0) | (F.get("p", F.size("p") - 1).end_pos != F.length("text"))
    wrong = F.exists("p", lambda y: F.substring(F.col("text"), y.start_pos + 1, y.end_pos - y.start_pos) != y.piece)
    return x.agg(
        F.count("text").alias("items_in"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars_in"), F.count("p").alias("items_out"), F.count_if(F.col("longest") > F.col("max_chars")).alias("too_long"),
        F.count_if(F.coalesce(holes | ends, F.lit(True))).alias("with_gaps"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong_text"),
    )


def sized_items(exports: DataFrame, chapters: DataFrame, limits: DataFrame) -> DataFrame:
    """Exports and chapters with the limits of their kind."""
    e = exports.select(F.lit("export").alias("origin"), F.col("export_id").cast("string").alias("item_id"), F.col("primary_markdown").alias("text"))
    c = chapters.select(F.lit("chapter").alias("origin"), F.concat_ws("/", "export_id", "chapter_no").alias("item_id"), F.col("markdown").alias("text"))
    sizes = limits.select(F.col("item_kind").alias("origin"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    return e.unionByName(c).where("item_id is not null and text is not null").join(F.broadcast(sizes), "origin")


def oversized(items: DataFrame) -> DataFrame:
    """The items longer than their limit: those that the splitter cuts. Shorter ones are one piece and need no splitting."""
    long = items.where(F.length("text") > F.col("max_chars"))
    return split_items(long).where("piece_no = 1").select("origin", "item_id").distinct()

"""Noise in text from scanned pages: found line by line, and repaired into continuous paragraphs.

Texts are cut into pages at page marks. Edge lines of pages whose folded form repeats on PAGES pages of one text or run
of pages are running headers; edge lines that give the page's number are page numbers. The words of the remaining body
are counted over all scanned texts. Rare words are joined in SQL with frequent ones that differ by a confusable
character group: the anagram hash of a word is the sum of a value of each of its characters, so that a confusion
changes it by a fixed difference, and an equi-join on hash plus difference finds the pairs; an exact check and a rank
by frequency follow. A line's last word that goes on in the next line is judged by hyphen evidence: the counts of the
joined word and of the compound with the hyphen.

Null and empty texts give nothing; a text without page marks is one page, where headers and numbers are taken from
lines that repeat or count on at a distance; ties between corrections go to the more frequent, then the alphabetically
first word; exact repeats of rows count once in the results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PAGES = 3  # pages on which a header repeats
NEAR = 24  # pages that a run's headers lie within
RATIO = 10  # times that a word is more frequent than its misread form
FREQUENT = 5  # least count of a word that corrects another
OFTEN = 0.4  # share of the pages on which a line repeats that ends as a sentence does, yet is a header
FILTER = 1 << 25  # bits of the filter of misread words
PROBES = 3
EDGE = 2  # lines at a page's top and bottom where headers and numbers stand

#: Character groups as misread, and as they were (fixed values).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("0", "o"), ("1", "i"), ("1", "l"), ("1", "í"), ("1", "t"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("ii", "ü"),
    ("u", "ii"), ("cl", "d"), ("d", "cl"), ("9", "g"), ("rn", "m"), ("m", "rn"), ("5", "s"), ("l", "i"), ("i", "l"), ("li", "h"), ("h", "li"), ("6", "b"),
    ("6", "ó"), ("6", "é"), ("8", "b"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("n", "rr"), ("rr", "n"), ("vv", "w"), ("w", "vv"), ("f", "e"), ("q", "g"),
    ("g", "q"), ("u", "n"), ("n", "u"), ("o", "c"), ("c", "o"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬁ", "fí"), ("0", "ó"), ("0", "ö"), ("1", "ì"), ("|", "l"), ("!", "l"), ("2", "z"),
)
HYPHENS = "-¬­‐‑"
_MARK = re.compile(r"^\s*<!--\s*page\s+(\d+)\s*-->\s*$", re.I)
_NUM = r"[0-9IlOoSBi|]{1,4}|[ivxlcdmIVXLCDM]{1,8}"
_WORDED = r"(?:page|pag|pág|página|pagina|seite|p|s|стр|страница|blatt|folio|fol|f)"
_NUMBER = re.compile(rf"^[\s\-–—\[(|·•*]*(?:{_WORDED}\.?\s*)?[\s\-–—\[(]*({_NUM})\s*(?:(?:/|de|of|von|di|sur)\s*\d{{1,4}})?[\s\-–—\])|·•*.]*$", re.I)
_MARKED = re.compile(rf"^\W*{_WORDED}\b|^[-–—\[(]\s*\w+\s*[-–—\])]$|^\w+ ?/ ?[0-9]+$", re.I)
_LEADNUM = re.compile(rf"^({_NUM})\s*(?:[|·–—-]\s*)?(?=\s|[|])\s*[|·–—]?\s*(\S.*)$")
_TAILNUM = re.compile(rf"^(.*\S)\s+(?:[|·–—]\s*)?({_NUM})$")
_ENDED = re.compile(r"[.,;:!?…]\s*$")
_TOKEN = re.compile(r"[\w�]+(?:­[\w�]+)*")
_CODE = re.compile(r"^(?:[^\W\d]?\d+[^\W\d]?|_+)$")
_SPACED = re.compile(r"(?<![\w.'’])(?:[^\W\d_] ){2,}[^\W\d_](?![\w'’]|\.\s?\w)")
_COMPOUND = re.compile(r"(?=\b([^\W\d_]{2,})-([^\W\d_]{2,}))")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def number(text: str) -> int | None:
    """The number that a page number's characters mean, misread digits and roman numerals included."""
    low = text.lower()
    if re.fullmatch(r"[ivxlcdm]+", low) and not re.fullmatch(r"[il]{1,2}", low):
        total, last = 0, 0
        for ch in reversed(low):
            v = _ROMAN[ch]
            total += v if v >= last else -v
            last = max(last, v)
        return total
    digits = text.translate(str.maketrans("IlOoSBi|", "11005811"))
    return int(digits) if digits.isdigit() else None


def fold(text: str) -> str:
    """A header's form without accents, case, signs and the difference of confusable characters."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    flat = flat.replace("rn", "m").replace("vv", "w")
    return re.sub(r"[\W_]+", "", flat.translate(str.maketrans("cft1l|!05689qy", "eeeiiiiosbbgqv")))


def head_keys(line: str) -> list[tuple[str, str | None]]:
    """(key, number text) readings of a line as a header, with and without a number beside it."""
    s = line.strip()
    out = []
    if not s:
        return out
    for pattern, rest, num in ((_TAILNUM, 1, 2), (_LEADNUM, 2, 1)):
        if (m := pattern.match(s)) and number(m.group(num)) is not None and any(c.isdigit() for c in m.group(num)) | (len(m.group(num)) > 1) | (m.group(num) in "Il"):
            key = fold(m.group(rest).strip(" |·–—-"))
            if len(key) >= 4:
                out.append((key, m.group(num)))
    key = fold(s)
    if len(key) >= 4:
        out.append((key, None))
    return out


def alike(a: str, b: str) -> bool:
    """Whether two folded headers are equal but for damage."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 6:
        return False
    most = 2 if len(a) >= 10 else 1
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    return _edits(a, b, at, most)


def _edits(a: str, b: str, at: int, most: int) -> bool:
    """Whether a and b, equal up to a place, differ by at most so many edits: each edit goes on along the equal rest."""
    here = {0: at}  # diagonal -> how far a is read
    for left in range(most, -1, -1):
        nxt: dict[int, int] = {}
        for d, i in here.items():
            while i < len(a) and 0 <= i + d < len(b) and a[i] == b[i + d]:
                i += 1
            if i == len(a) and i + d == len(b):
                return True
            if left:
                for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                    if ii <= len(a) and ii + dd <= len(b) and ii > nxt.get(dd, -1):
                        nxt[dd] = ii
        here = nxt
    return False


class Near:
    """Keys that are alike, found without comparing all pairs.

    At most two edits leave one of a key's three parts whole, moved by two places at most: an index of parts finds them.
    """

    def __init__(self, keys: Iterable[str]) -> None:
        self.keys = set(keys)
        self.lengths = {len(k) for k in self.keys}
        self.index: dict[tuple[int, int, str], list[str]] = {}
        for k in self.keys:
            if len(k) >= 6:
                third = len(k) // 3
                for i, part in enumerate((k[:third], k[third : 2 * third], k[2 * third :])):
                    self.index.setdefault((len(k), i, part), []).append(k)

    def of(self, key: str) -> set[str]:
        found = {key} if key in self.keys else set()
        seen = set(found)
        for n in range(max(6, len(key) - 2), len(key) + 3):
            if n not in self.lengths:
                continue
            third = n // 3
            for i, size in ((0, third), (1, third), (2, n - 2 * third)):
                for at in range(max(0, i * third - 2), i * third + 3):
                    for k in self.index.get((n, i, key[at : at + size]), ()):
                        if k not in seen:
                            seen.add(k)
                            if alike(key, k):
                                found.add(k)
        return found


class Page:
    def __init__(self, lines: list[int], mark: int | None) -> None:
        self.lines, self.mark = lines, mark


def pages_of(lines: list[str]) -> list[Page]:
    out, here, mark = [], [], None
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        if m or "\f" in line:
            if line.replace("\f", "").strip() and not m:
                here.append(i)
            if here:
                out.append(Page(here, mark))
            here, mark = [], int(m.group(1)) if m else None
        else:
            here.append(i)
    if here:
        out.append(Page(here, mark))
    return out


def edges(page: Page, lines: list[str]) -> list[int]:
    """The line numbers of a page's edges, outermost first on each side."""
    full = [i for i in page.lines if lines[i].strip()]
    if len(full) <= 2 * EDGE:
        return full
    return full[:EDGE] + full[: -EDGE - 1 : -1]


def _number_line(line: str) -> str | None:
    s = line.strip()
    m = _NUMBER.match(s)
    if not m or number(m.group(1)) is None or (")" in s) != ("(" in s) or ("]" in s) != ("[" in s):
        return None
    return None if s.endswith(".") and s[0].isdigit() else m.group(1)


def _after_colon(i: int, lines: list[str]) -> bool:
    """Whether a line's number belongs to the text: the line before it announces it."""
    j = i - 1
    while j >= 0 and not lines[j].strip():
        j -= 1
    return j >= 0 and lines[j].rstrip().endswith((":", "："))


def margins(lines: list[str], pages: list[Page], known: list[str], given: int | None = None) -> tuple[set[int], set[int]]:
    """(header lines, page number lines). known: header keys from neighbouring pages of the run; given: the page's number."""
    heads: set[int] = set()
    numbers: set[int] = set()
    keyed: dict[int, list[tuple[str, str | None]]] = {}
    edge = {i for p in pages for i in edges(p, lines)}
    alone = {i for i in edge if (_number_line(lines[i])) is not None and not _after_colon(i, lines)}
    for i in edge - alone:
        keyed[i] = head_keys(lines[i])
    where: dict[str, set[int]] = {}
    page_of = {i: k for k, p in enumerate(pages) for i in p.lines}
    for i, keys in keyed.items():
        for key, _ in keys:
            where.setdefault(key, set()).add(page_of[i])
    strong = set(known)
    beside = dict.fromkeys(where, frozenset())
    if len(pages) >= PAGES:
        near = Near(where)
        beside = {key: near.of(key) for key in where}
        ended = {key for i, keys in keyed.items() if _ENDED.search(lines[i]) for key, _ in keys}
        for key, seen in where.items():
            found = seen if len(seen) >= PAGES and key not in ended else set().union(*(where[k] for k in beside[key]))
            if len(found) >= PAGES and (key not in ended or len(found) >= OFTEN * len(pages)):
                strong.add(key)
    if strong:
        given_near = Near(known)
        for i, options in keyed.items():
            for key, num in options:
                if key in strong or not strong.isdisjoint(beside[key]) or (known and given_near.of(key)):
                    heads.add(i)
                    if num is not None and not lines[i].strip().endswith((".", ",")):
                        numbers.add(i)
                    break
    numbers |= alone
    return heads, numbers


def margins_unmarked(lines: list[str]) -> tuple[set[int], set[int]]:
    """As margins, for a text of many pages without page marks: by lines that repeat or count on at a distance."""
    heads: set[int] = set()
    numbers: set[int] = set()
    where: dict[str, list[tuple[int, str | None]]] = {}
    width = max(map(len, lines))
    for i, line in enumerate(lines):
        s = line.strip()
        bare = re.sub(r"^[\dIlOo]+\s+|\s+[|·]?\s*[\dIlOo]+$", "", s)
        if not s or len(bare) > 0.8 * width or s[-1] in ".,;:!?…-" or s[0].islower() or re.search(r"[.!?…] ", s) or _number_line(s) is not None:
            continue  # full lines, and lines that hold a sentence's end, are body
        for key, num in head_keys(s):
            where.setdefault(key, []).append((i, num))
    for at in where.values():
        rows = [i for i, _ in at]
        if 1 + sum(b - a >= 6 for a, b in zip(rows, rows[1:])) >= PAGES:
            heads |= set(rows)
            numbers |= {i for i, num in at if num is not None}
    strong = {k for k, at in where.items() if any(i in heads for i, _ in at)}
    near = Near(strong)
    for key, at in where.items():
        if key not in strong and near.of(key):
            heads |= {i for i, _ in at}
            numbers |= {i for i, num in at if num is not None}
    loose = [(i, number(_number_line(lines[i]) or "x")) for i in range(len(lines)) if _number_line(lines[i]) is not None and not _after_colon(i, lines)]
    at_value: dict[int, list[int]] = {}
    for i, v in loose:
        if v is not None:
            at_value.setdefault(v, []).append(i)
    for i, v in loose:
        beside = any(j in heads for j in (i - 2, i - 1, i + 1, i + 2))
        # another number that counts on, as many pages away as it should be at least
        steps = v is not None and any((j - i) * k > 0 and abs(j - i) >= 6 * abs(k) for k in (-3, -2, -1, 1, 2, 3) for j in at_value.get(v + k, ()))
        if beside or steps or _MARKED.search(lines[i].strip()):
            numbers.add(i)
    return heads, numbers


def _words(line: str) -> list[tuple[str, int]]:
    """(lower-case word, position) of a body line; codes and numbers are none."""
    return [(m.group().lower(), m.start()) for m in _TOKEN.finditer(line) if not _CODE.match(m.group())]


def read(text: str, origin: str, known: list[str] | None = None, given: int | None = None) -> dict:
    """What a scanned text's lines hold: margins, words, words cut at line ends, spaced-out words."""
    lines = text.split("\n")
    pages = pages_of(lines)
    if origin == "export" and len(pages) == 1:
        heads, numbers = margins_unmarked(lines)
        if not heads and not numbers:
            heads, numbers = margins(lines, pages, known or [], given)
    else:
        heads, numbers = margins(lines, pages, known or [], given)
    skip = heads | numbers
    body = [i for p in pages for i in p.lines if i not in skip and lines[i].strip()]
    words: list[tuple[int, str]] = []
    cuts: list[tuple[int, int, str, str, str]] = []
    spaced: list[tuple[int, str]] = []
    compounds: Counter = Counter()
    tail: tuple[int, str] | None = None
    lead: str | None = None
    pending: tuple[int, str, str] | None = None
    for i in body:
        line = lines[i].rstrip()
        runs = _SPACED.findall(line)
        if runs:
            spaced += [(i, r.replace(" ", "").lower()) for r in runs]
            line = _SPACED.sub(" ", line)
        here = _words(line)
        for a, b in _COMPOUND.findall(line):
            compounds[f"{a.lower()}-{b.lower()}"] += 1
        if lead is None:
            first = re.match(r"\W*([\w�]+)", line)
            lead = first.group(1) if first else ""
        if pending is not None:
            k, part, inner = pending
            first = re.match(r"\s*([\w�]+)", line)
            if first and here and here[0][1] <= first.start(1) + 1:
                cuts.append((k, i, part, first.group(1), inner))
                here = here[1:]
            elif first:
                cuts.append((k, i, part, first.group(1), inner))
            pending = None
        m = re.search(rf"([\w�]+)[{HYPHENS}]$", line)
        if m and re.search(r"[^\W\d_]", m.group(1)):
            pending = (i, m.group(1), line)
            if here and here[-1][1] == m.start(1):
                here = here[:-1]
        words += [(i, w) for w, _ in here]
    if pending is not None:
        tail = (pending[0], pending[1])
    return {"heads": heads, "numbers": numbers, "words": words, "cuts": cuts, "spaced": spaced, "compounds": compounds, "tail": tail, "lead": lead}


def joined(part: str, rest: str) -> str:
    return (part + rest).lower()


# ---- Spark -------------------------------------------------------------------------------------------------------


def scanned(exports: DataFrame, issues: DataFrame) -> DataFrame:
    """origin, item_id, text_id, page, text of the scanned exports and of the pages under review."""
    e = exports.where("ocr_pages > 0").select(F.lit("export").alias("origin"), F.col("export_id").cast("string").alias("item_id"), F.col("export_id").alias("text_id"), F.lit(None).cast("int").alias("page"), F.col("primary_markdown").alias("text"))
    i = issues.select(F.lit("issue").alias("origin"), F.col("identifier").alias("item_id"), F.col("export_id").alias("text_id"), F.col("page_number").alias("page"), F.col("markdown").alias("text"))
    return e.unionByName(i).where("item_id is not null and trim(text) <> ''")


def run_headers(items: DataFrame) -> DataFrame:
    """text_id, page, known: the header keys of each page of a run of pages.

    A key is a header where it stands on PAGES pages of its text, or where it and the keys alike to it stand on as many
    pages of a range. Ranges of NEAR pages overlap, so an export with any number of pages is many small groups; a page
    gets the headers that stand in its ranges. Lines that end as a sentence does need OFTEN of the pages of their range.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for text_id, page, text in b.itertuples(index=False):
                lines = text.split("\n")
                for p in pages_of(lines):
                    for i in edges(p, lines):
                        if _number_line(lines[i]) is None:
                            rows |= {(text_id, page, key, _ENDED.search(lines[i]) is not None) for key, _ in head_keys(lines[i])}
            yield pd.DataFrame(sorted(rows), columns=["text_id", "page", "key", "ended"])

    def ranged(df: DataFrame) -> DataFrame:
        return df.withColumn("range", F.explode(F.array((F.col("page") / NEAR).cast("int") * 2, ((F.col("page") + NEAR // 2) / NEAR).cast("int") * 2 + 1)))

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text_id, range_, keys in b.itertuples(index=False):
                pages = {k["key"]: set(k["pages"]) for k in keys}
                every = len(set().union(*pages.values()))
                near = Near(pages)
                for k in keys:
                    n = len(set().union(*(pages[x] for x in near.of(k["key"]))))
                    if n >= PAGES and (not k["ended"] or n >= OFTEN * every):
                        out.append((text_id, range_, k["key"]))
            yield pd.DataFrame(out, columns=["text_id", "range", "key"])

    issue = items.where("origin = 'issue' and page is not null and text_id is not null").select("text_id", "page", "text")
    at = cut(issue.mapInPandas(keys, "text_id bigint, page int, key string, ended boolean").groupBy("text_id", "page", "key").agg(F.bool_or("ended").alias("ended")))
    in_range = ranged(at).groupBy("text_id", "range", "key").agg(F.collect_set("page").alias("pages"), F.bool_or("ended").alias("ended"))
    groups = in_range.groupBy("text_id", "range").agg(F.collect_list(F.struct("key", "pages", "ended")).alias("keys"))  # of NEAR pages at most
    groups = groups.where(F.size(F.array_distinct(F.flatten("keys.pages"))) >= PAGES)
    alike_ = groups.mapInPandas(united, "text_id bigint, range int, key string")
    whole = at.groupBy("text_id", "key").agg(F.countDistinct("page").alias("n"), F.bool_or("ended").alias("ended")).where((F.col("n") >= PAGES) & ~F.col("ended"))
    exact = ranged(at).join(whole.select("text_id", "key"), ["text_id", "key"], "left_semi").select("text_id", "range", "key")
    strong = alike_.unionByName(exact).distinct()
    return ranged(issue.select("text_id", "page").distinct()).join(strong, ["text_id", "range"]).groupBy("text_id", "page").agg(F.collect_set("key").alias("known"))


def with_headers(items: DataFrame) -> DataFrame:
    """The items with known, the header keys that their run of pages shows.

    Only review pages belong to runs; they are joined once and cut. Exports are whole texts, read as they are.
    """
    pages = items.where("origin = 'issue'")
    joined_ = pages.join(run_headers(items), ["text_id", "page"], "left").select(*items.columns, "known")
    whole = items.where("origin <> 'issue'").withColumn("known", F.lit(None).cast("array<string>"))
    return whole.unionByName(cut(joined_))


def _known(value: object) -> list[str]:
    return [] if value is None or isinstance(value, float) else sorted(value)


def _page(value: object) -> int | None:
    return None if value is None or value != value else int(value)


def vocabulary(items: DataFrame) -> DataFrame:
    """word, n: the words of all bodies, and compounds with their hyphen. Counts are combined in the workers first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for origin, known, page, text in zip(b["origin"], b["known"], b["page"], b["text"]):
                r = read(text, origin, _known(known), _page(page))
                c.update(w for _, w in r["words"])
                c.update(joined(p, x) for _, _, p, x, _ in r["cuts"] if x[:1].islower())
                c.update(r["compounds"])
            if len(c) > 100_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c.clear()
        yield pd.DataFrame({"word": pd.Series(list(c), dtype=object), "n": pd.Series(list(c.values()), dtype="int64")})

    counted = items.select("origin", "known", "page", "text").mapInPandas(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def anagram(word: Column) -> Column:
    """The anagram hash: a sum over the characters, whatever their order."""
    mask = F.lit((1 << 44) - 1)
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda s, c: s + F.xxhash64(c).bitwiseAND(mask))


def corrections(vocab: DataFrame) -> DataFrame:
    """word, right, place: a misread word, what it was, and where the misread characters begin (from 0).

    The table of differences is a constant of a few dozen entries; each rare word meets only those whose misread
    group it holds, and the hash finds its partners.
    """
    own = vocab.where(~F.col("word").contains("-")).withColumn("h", anagram(F.col("word")))
    differences = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (anagram(F.lit(b)) - anagram(F.lit(a))).alias("d")) for a, b in CONFUSIONS])
    rare = own.where("length(word) >= 2").select("word", "n", "h", F.explode(F.filter(differences, lambda x: F.instr(F.col("word"), x.a) > 0)).alias("x"))
    rare = rare.select("word", "n", (F.col("h") + F.col("x.d")).alias("h"), "x.a", "x.b")
    good = own.where((F.col("n") >= FREQUENT) & F.col("word").rlike("^\\p{L}{2,}$")).select(F.col("word").alias("right"), F.col("n").alias("m"), "h")
    pairs = rare.join(good, "h").where((F.col("m") >= RATIO * F.col("n")) & ((F.length("word") > 2) | (F.col("m") >= 100 * F.col("n"))))
    # exact check: the misread group stands where the right one stands
    starts = F.sequence(F.lit(1), F.length("word"))
    fits = F.filter(
        starts,
        lambda i: (F.substr(F.col("word"), i, F.length("a")) == F.col("a"))
        & (F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.col("b"), F.substr(F.col("word"), i + F.length("a"))) == F.col("right")),
    )
    pairs = pairs.withColumn("place", F.try_element_at(fits, F.lit(1)) - 1).where("place is not null")
    # a lost character stands for any one: equi-join on the rest of the word and its place
    rest = lambda w, i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))
    lost = own.where("length(replace(word, '\ufffd', '')) = length(word) - 1 and length(word) > 3").withColumn("i", F.instr("word", "\ufffd"))
    lost = lost.select("word", rest(F.col("word"), F.col("i")).alias("rest"), "i")
    whole = good.select("right", "m", F.explode(F.sequence(F.lit(1), F.length("right"))).alias("i")).withColumn("rest", rest(F.col("right"), F.col("i")))
    found = lost.join(whole, ["rest", "i"]).select("word", "right", "m", (F.col("i") - 1).alias("place"))
    best = F.max_by(F.struct("right", "place"), F.struct("m", "right"))
    return pairs.select("word", "right", "m", "place").unionByName(found).groupBy("word").agg(best.alias("x")).select("word", "x.right", "x.place")


LOOK = "origin string, item_id string, text_id bigint, page int, line_no int, kind string, word string, other string, line2 int, cut int"


class Filter:
    """A Bloom filter of words, of fixed size whatever their number: it lets every one of them pass, and few others."""

    def __init__(self, cells: list[tuple[int, int]], bits: int) -> None:
        self.bits = bits
        self.cells = np.zeros(bits // 64, np.int64)
        for at, mask in cells:
            self.cells[at] = mask

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        low, high = h & 0xFFFFFFFF, h >> 32
        for i in range(PROBES):
            at = (low + i * high) % self.bits
            if not int(self.cells[at >> 6]) >> (at & 63) & 1:
                return False
        return True


def word_filter(words: DataFrame, bits: int = FILTER) -> Filter:
    """The filter of the distinct words of a frame. At most bits / 64 cells come to the driver (4 MB)."""
    h = F.xxhash64("word")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    at = words.select(F.explode(F.array(*[F.pmod(low + high * i, F.lit(bits)) for i in range(PROBES)])).alias("at"))
    cells = at.groupBy(F.expr("at div 64").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    return Filter([tuple(r) for r in cells.collect()], bits)


def look(items: DataFrame, misread: Filter) -> DataFrame:
    """The margin lines, and what has to be looked up: words that may be misread, cut words, spaced-out words."""
    shared = items.sparkSession.sparkContext.broadcast(misread)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passes = lru_cache(200_000)(shared.value.__contains__)
        for b in batches:
            rows: list[tuple] = []
            for origin, item, text_id, page, known, text in zip(b["origin"], b["item_id"], b["text_id"], b["page"], b["known"], b["text"]):
                page = _page(page)
                r = read(text, origin, _known(known), page)
                me = (origin, item, text_id, page)
                rows += [(*me, i, "header", None, None, None, None) for i in r["heads"]]
                rows += [(*me, i, "page_number", None, None, None, None) for i in r["numbers"]]
                for i, w in set(r["words"]):
                    bad = "�" in w or "ﬁ" in w or "ﬂ" in w
                    if bad or passes(w):
                        rows.append((*me, i, "char" if bad else "word", w, None, None, None))
                rows += [(*me, i, "char" if len(w) > 3 else "spaced", w, None, None, None) for i, w in r["spaced"]]
                for i, k, part, rest, _ in r["cuts"]:
                    rows.append((*me, i, "cut", part, rest, k, None))
                    w = joined(part, rest)
                    if "�" in w or "ﬁ" in w or "ﬂ" in w:
                        at = next(p for p, ch in enumerate(w) if ch in "�ﬁﬂ")
                        rows.append((*me, i if at < len(part) else k, "char", w, None, None, None))
                    elif (rest[:1].islower() or rest[:1].isdigit()) and passes(w):
                        rows.append((*me, i, "word", w, None, k, len(part)))
                if r["tail"] is not None:
                    rows.append((*me, r["tail"][0], "tail", r["tail"][1], None, None, None))
                if r["lead"]:
                    rows.append((*me, -1, "lead", r["lead"], None, None, None))
            out = pd.DataFrame(rows, columns=["origin", "item_id", "text_id", "page", "line_no", "kind", "word", "other", "line2", "cut"])
            yield out.astype({"page": "Int32", "line2": "Int32", "cut": "Int32"})

    return items.select("origin", "item_id", "text_id", "page", "known", "text").mapInPandas(run, LOOK)


def defects(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origin, item_id, line_no, defect) of every noisy line, and (word, right) of the misread words."""
    items = with_headers(items)
    vocab = cut(vocabulary(items))
    fixes = cut(corrections(vocab))
    seen = cut(look(items, word_filter(fixes)))
    margin = seen.where("kind in ('header', 'page_number')").select("origin", "item_id", "line_no", F.col("kind").alias("defect"))
    direct = seen.where("kind = 'char'").select("origin", "item_id", "line_no", F.lit("char").alias("defect"))
    words = seen.where("kind = 'word'").join(fixes, "word")
    misread = words.select("origin", "item_id", F.when(F.col("place") >= F.col("cut"), F.col("line2")).otherwise(F.col("line_no")).alias("line_no"), F.lit("char").alias("defect"))
    spaced = seen.where("kind = 'spaced'").join(vocab.where("n >= 3").select("word"), "word", "left_semi").select("origin", "item_id", "line_no", F.lit("char").alias("defect"))
    # the rest of a page's last word opens the next page
    lead = seen.where("kind = 'lead' and origin = 'issue' and page is not null").select("text_id", (F.col("page") - 1).alias("page"), F.col("word").alias("other")).groupBy("text_id", "page").agg(F.min("other").alias("other"))
    tails = seen.where("kind = 'tail'").drop("other").join(lead, ["text_id", "page"], "left").select("origin", "item_id", "line_no", "word", "other")
    cuts = seen.where("kind = 'cut'").select("origin", "item_id", "line_no", "word", "other").unionByName(tails)
    cuts = cuts.withColumn("part", F.lower("word")).withColumn("rest", F.lower(F.coalesce("other", F.lit(""))))
    cuts = cuts.withColumn("whole", F.concat("part", "rest")).withColumn("compound", F.concat_ws("-", "part", "rest"))
    count = vocab.select("word", "n")
    first = vocab.where(F.col("word").contains("-")).groupBy(F.split("word", "-")[0].alias("part")).agg(F.sum("n").alias("n_first"))
    cuts = cuts.drop("word").join(count.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left")
    cuts = cuts.join(count.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left").join(first, "part", "left")
    whole, compound, leads = (F.coalesce(c, F.lit(0)) for c in ("n_whole", "n_compound", "n_first"))
    opens_low = F.col("other").rlike("^[\\p{Ll}\\x{FFFD}0-9]")
    broken = (
        F.when(F.col("other").isNull(), leads == 0)
        .when(compound > whole, F.lit(False))
        .when(~opens_low, F.lit(False))
        .when((whole > 1) & (whole >= compound), F.lit(True))
        .otherwise((leads < 3) | (F.length("part") < 3))
    )
    hyphen = cuts.where(broken).select("origin", "item_id", "line_no", F.lit("hyphen").alias("defect"))
    found = margin.unionByName(direct).unionByName(misread).unionByName(spaced).unionByName(hyphen).where("line_no >= 0").distinct()
    return found, fixes


# ---- repair ------------------------------------------------------------------------------------------------------


def repair(text: str, drop: set[int], hyphens: set[int], right: dict[str, str]) -> list[str]:
    """The continuous paragraphs of a scanned text."""
    lines = text.split("\n")

    def fix(m: re.Match) -> str:
        w = m.group()
        good = right.get(w.lower())
        if good is None:
            return w
        return good.upper() if w.isupper() and len(w) > 1 else good[:1].upper() + good[1:] if w[:1].isupper() else good

    out: list[str] = []
    held, glue, blank, crossed = "", False, False, False
    for i, line in enumerate(lines):
        if i in drop or _MARK.match(line) or "\f" in line:
            crossed = True
            if i in drop or not line.replace("\f", "").strip() or _MARK.match(line):
                continue
        s = line.replace("\f", "").strip()
        if not s:
            blank = True
            continue
        s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s).replace("ﬁ", "fi").replace("ﬂ", "fl")
        # a blank line ends a paragraph, but not where a page breaks inside a sentence
        if held and not glue and blank and (not crossed or re.search(r"[.!?…:][\"”»)]*$", held)):
            out.append(held)
            held = ""
        held = held + s if glue else f"{held} {s}".strip()
        glue, blank, crossed = i in hyphens, False, False
        if glue:
            held = held.rstrip()[:-1]
        elif s[-1:] in HYPHENS and len(s) > 1 and s[-2].isalpha():
            glue = True  # a compound cut at its own hyphen keeps it
    if held:
        out.append(held)
    return [_TOKEN.sub(fix, p) for p in out]


def paragraphs(items: DataFrame) -> DataFrame:
    """origin, item_id, paragraph_no, paragraph of every scanned text, repaired."""
    found, fixes = defects(items)
    lines = found.groupBy("origin", "item_id").agg(
        F.collect_set(F.when(F.col("defect").isin("header", "page_number"), F.col("line_no"))).alias("drops"),
        F.collect_set(F.when(F.col("defect") == "hyphen", F.col("line_no"))).alias("hyphens"),
    )
    tokens = items.select("origin", "item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}\\x{FFFD}]+)"), F.lit(1)))).alias("word"))
    right = tokens.join(fixes.select("word", "right"), "word").groupBy("origin", "item_id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
    rows = items.join(lines, ["origin", "item_id"], "left").join(right, ["origin", "item_id"], "left").select("origin", "item_id", "text", "drops", "hyphens", "fixes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: [] if x is None or isinstance(x, float) else list(x)
        for b in batches:
            out = []
            for origin, item, text, drops, hyphens, pairs in b.itertuples(index=False):
                known = {p["word"]: p["right"] for p in some(pairs)}
                out += [(origin, item, k, p) for k, p in enumerate(repair(text, set(some(drops)), set(some(hyphens)), known))]
            yield pd.DataFrame(out, columns=["origin", "item_id", "paragraph_no", "paragraph"])

    return rows.mapInPandas(run, "origin string, item_id string, paragraph_no int, paragraph string")

"""Whether a version of a Markdown text keeps what another one has: checks, structure, segments, headings, polarity.

Frames hold a unique key, a source and a target text. Rows where either is null give nothing. Everything but the
similarity of segments and the pairing of emphasis is a projection of the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .compare import heading_levels_of, similarity

DETAILS = 20  # detailed issues of a report
#: Order of issues in a report (fixed values).
PRIORITY = {"length": 1, "source_text": 2, "fidelity": 3, "language": 4, "alignment": 4}


def _lines(text: Column, pattern: str) -> Column:
    return T.matches(T.lines_unix(text), r"(?m)^" + pattern)


def checks(text: Column) -> dict[str, Column]:
    """What must be equal in both versions, in the order in which it is checked: each a sorted or ordered array."""
    bare = F.regexp_replace(T.lines_unix(text), r"(?dms)^[ \t]{0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)", " ")
    as_text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return {
        "numbers": F.array_sort(T.number_tokens(text)),
        "symbols": F.array_sort(T.symbol_tokens(text)),
        "roman": F.array_sort(as_text(T.roman_references(text))),
        "addresses": F.array_sort(T.link_targets(text)),
        "code": F.array_sort(T.code_spans(bare)),
        "fences": _lines(text, r"[ \t]{0,3}(?:```|~~~)"),
        "headings": as_text(heading_levels_of(bare)),
        "tables": F.transform(_lines(bare, r"[ \t]*\|[^\n]*\|[ \t]*$"), lambda x: F.size(F.split(x, r"\|")).cast("string")),
        "lists": F.transform(_lines(bare, r"[ \t]{0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]"), lambda x: F.when(F.regexp_like(x, F.lit("[0-9]")), "1").otherwise("-")),
        "quotes": F.transform(_lines(bare, r"[ \t]{0,3}>+"), F.trim),
        "images": T.matches(text, r"!\[[^\]\n]*\]\(([^)\n]*)\)", 1),
        "comments": T.comments(text),
        "tags": F.transform(T.matches(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"</?[A-Za-z][A-Za-z0-9]*"), F.lower),
    }


def findings(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, place, rule of every check that a target breaks; place is the rule's place in the order."""
    a, b = checks(F.col(source)), checks(F.col(target))
    broken = F.array_compact(F.array(*[F.when(a[name] != b[name], F.struct(F.lit(i).alias("place"), F.lit(name).alias("rule"))) for i, name in enumerate(a)]))
    return pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(key, F.explode(broken).alias("x")).select(key, "x.*")


def significant(text: Column) -> Column:
    """The letters and digits of a text, in small letters, sorted."""
    return F.array_sort(T.matches(F.lower(text), r"[\p{L}\p{N}]"))


def covers_table(table: Column, lines: Column) -> Column:
    """Whether a reconstructed table holds exactly the letters and digits of the lines that it was built from."""
    return F.coalesce(significant(table) == significant(lines), F.lit(False))


def tag_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, tag, opened, closed of each HTML tag outside code and comments; tags that close themselves count as both."""
    bare = F.regexp_replace(F.regexp_replace(T.lines_unix(F.col(text)), r"(?s)<!--.*?-->", " "), r"`[^`\n]*`", " ")
    t = df.where(F.col(text).isNotNull()).select(key, F.explode(T.matches(bare, r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t][^<>\n]*)?/?>")).alias("t"))
    name = F.lower(F.regexp_extract("t", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    ends = F.col("t").startswith("</")
    both = F.col("t").endswith("/>") | name.isin("br", "hr", "img", "meta", "link", "input", "col")
    return t.groupBy(key, name.alias("tag")).agg(F.count_if(~ends).alias("opened"), F.count_if(ends | both).alias("closed"))


def heading_fidelity(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, issue, expected, actual: headings missing or added, or of other levels, as texts of their levels."""
    a, b = heading_levels_of(F.col(source)), heading_levels_of(F.col(target))
    said = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    issue = F.when(F.size(b) < F.size(a), "missing").when(F.size(b) > F.size(a), "added").when(a != b, "levels")
    return pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull() & issue.isNotNull()).select(key, issue.alias("issue"), said(a).alias("expected"), said(b).alias("actual"))


def heading_variants(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, heading, variants: headings of a source, equal but for case, that its target translates in more than one way.

    Headings are aligned by their place; pairs with another number of headings give nothing.
    """
    named = lambda c: T.matches(T.lines_unix(F.col(c)), r"(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\n]+)$", 1)
    x = pairs.select(key, named(source).alias("a"), named(target).alias("b")).where(F.size("a") == F.size("b"))
    x = x.select(key, F.explode(F.arrays_zip("a", "b")).alias("h")).select(key, F.lower(F.trim("h.a")).alias("heading"), F.lower(F.trim("h.b")).alias("other"))
    return x.groupBy(key, "heading").agg(F.countDistinct("other").alias("variants")).where("variants > 1")


def list_breaks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, stated, expected: items of ordered lists that do not count on; a list may begin anywhere, and again at 1."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(T.lines_unix(F.col(text)), "\n")).alias("line_no", "line"))
    n = F.regexp_extract("line", r"^[ \t]{0,3}([0-9]{1,6})[.)][ \t]", 1)
    order = W.partitionBy(key).orderBy("line_no")
    filled = lines.where(F.trim("line") != "").withColumn("stated", F.when(n != "", n.cast("int")))
    seen = filled.withColumn("before", F.lag("stated").over(order)).where("stated is not null and before is not null and stated <> 1 and stated <> before + 1")
    return seen.select(key, "line_no", "stated", (F.col("before") + 1).alias("expected"))


def normalised_levels(levels: Column) -> Column:
    """The levels of a text's headings without jumps: the first is 1, and none is more than one below the one before."""
    start = F.named_struct(F.lit("last"), F.lit(0), F.lit("out"), F.array().cast("array<int>"))

    def step(a: Column, x: Column) -> Column:
        level = F.least(x, a["last"] + 1).cast("int")
        return F.named_struct(F.lit("last"), level, F.lit("out"), F.concat(a["out"], F.array(level)))

    return F.aggregate(levels, start, step, lambda a: a["out"])


def context(blocks: DataFrame, key: str, order: str, block: str, size: int = 80) -> DataFrame:
    """key, order, before, after: the end of the block before and the beginning of the one after, of at most size characters."""
    w = W.partitionBy(key).orderBy(order)
    flat = F.trim(F.regexp_replace(F.col(block), r"[ \t\n\r\f]+", " "))
    x = blocks.withColumn("_f", flat)
    return x.select(key, order, F.expr(f"right(lag(_f) over (partition by {key} order by {order}), {size})").alias("before"), F.substring(F.lead("_f").over(w), 1, size).alias("after"))


#: Words of denial (fixed values); a sentence's polarity is whether it holds an odd number of them.
DENIALS = {
    "en": "no|not|never|none|nobody|nothing|neither|nor|cannot|without", "es": "no|nunca|jamás|nadie|nada|ninguno|ninguna|tampoco|sin", "fr": "ne|jamais|personne|rien|aucun|aucune|sans",
    "de": "nicht|kein|keine|keinen|nie|niemals|niemand|nichts|ohne", "pt": "não|nunca|jamais|ninguém|nada|nenhum|nenhuma|sem", "it": "non|mai|nessuno|niente|nulla|nessuna|senza",
}


def denials(text: Column, language: Column) -> Column:
    """How many words of denial a text holds; null for a language without a list."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(text), r"n[’']t(?![\p{L}])", " not"), r"[^\p{L}]+", "  "), F.lit(" "))
    out = F.lit(None).cast("int")
    for code, words in DENIALS.items():
        out = F.when(language == code, F.regexp_count(flat, F.lit(f" (?:{words}) "))).otherwise(out)
    return out


def polarity(pairs: DataFrame, key: str, source: str, target: str, source_language: str, target_language: str) -> DataFrame:
    """key, source_denials, target_denials of the pairs of which one side denies and the other does not."""
    a, b = denials(F.col(source), F.col(source_language)), denials(F.col(target), F.col(target_language))
    return pairs.select(key, a.alias("source_denials"), b.alias("target_denials")).where((F.col("source_denials") == 0) != (F.col("target_denials") == 0))


def segment_issues(pairs: DataFrame, key: str, source: str, target: str, code: Column | None = None) -> DataFrame:
    """key, issue: the first of the rules that a translated segment breaks.

    alignment: one side is blank. source_text: a sentence of 24 letters or more stands unchanged in the target, or the
    segments are alike by .92 (by .97 in their letters alone). fidelity: a number, sign or address differs. length: the
    ratio of letters is outside .55 to 1.80 (from 80 letters on), or above 2.50 and 80 letters more (from 20 on).
    Segments equal in both languages for a reason (names, numbers, addresses: fewer than 24 letters) are none.
    """
    s, t = F.col(source), F.col(target)
    n, m = T.letters(s), T.letters(t)
    sentences = F.filter(F.transform(T.matches(T.lines_unix(s), r"[^.!?…\n]+[.!?…]"), F.trim), lambda x: T.letters(x) >= 24)
    kept = F.exists(sentences, lambda x: F.contains(t, x))
    differs = (F.array_sort(T.number_tokens(s)) != F.array_sort(T.number_tokens(t))) | (F.array_sort(T.symbol_tokens(s)) != F.array_sort(T.symbol_tokens(t))) | (F.array_sort(T.link_targets(s)) != F.array_sort(T.link_targets(t)))
    x = pairs.where(s.isNotNull() & t.isNotNull()).select(key, source, target, n.alias("_n"), m.alias("_m"), kept.alias("_k"), differs.alias("_d"))
    blank = (F.trim(source) == "") != (F.trim(target) == "")
    only = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}]", "")
    near = (F.col("_n") >= 24) & ~F.col("_k") & (F.least("_n", "_m") / F.greatest("_n", "_m") >= 0.85)
    alike = (similarity(F.when(near, F.col(source)), F.when(near, F.col(target)), 0.92) >= 0.92) | (similarity(F.when(near, only(source)), F.when(near, only(target)), 0.97) >= 0.97)
    r = F.col("_m") / F.col("_n")
    bad = ((F.col("_n") >= 80) & ((r < 0.55) | (r > 1.8))) | ((F.col("_n") >= 20) & (F.col("_n") < 80) & (r > 2.5) & (F.col("_m") > F.col("_n") + 80))
    issue = F.when(blank, "alignment").when(F.col("_k") | (near & alike), "source_text").when(F.col("_d"), "fidelity").when(bad, "length")
    return x.select(key, issue.alias("issue")).where("issue is not null")


def issue_report(issues: DataFrame, key: str, details: int = DETAILS) -> DataFrame:
    """key, issue, detailed of the first issues by priority, at most so many over all; the others are counted by issue_totals."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("issue")], F.lit(9))
    return issues.select(key, "issue", order.alias("_p")).orderBy("_p", key, "issue").limit(details).select(key, "issue")


def disagreements(pairs: DataFrame, key: str, native: str, scanned: str) -> DataFrame:
    """key, place, native, scanned: words that two readings of a page have differently at the same place.

    Words are matched in sequence; stretches that differ are paired word by word where both have as many words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x, y in b.itertuples(index=False):
                p, q = x.split(), y.split()
                for op, i, i2, j, j2 in SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
                    if op == "replace" and i2 - i == j2 - j:
                        rows += [(k, i + n, p[i + n], q[j + n]) for n in range(i2 - i)]
            yield pd.DataFrame(rows, columns=["k", "place", "native", "scanned"])

    kind = dict(pairs.dtypes)[key]
    both = pairs.where(F.col(native).isNotNull() & F.col(scanned).isNotNull()).select(F.col(key).alias("k"), F.col(native).alias("a"), F.col(scanned).alias("b"))
    return both.mapInPandas(run, f"k {kind}, place int, native string, scanned string").withColumnRenamed("k", key)


def ordered_copy(part: Column, whole: Column, least: int = 12, share: float = 0.9, gap: int = 4) -> Column:
    """Whether a block repeats a page's words in their order: of at least so many words a share matches in sequence, with no longer run unmatched."""

    def one(x: str | None, y: str | None) -> bool:
        p, q = (x or "").lower().split(), (y or "").lower().split()
        if len(p) < least:
            return False
        same = [m for m in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks() if m.size]
        ends = [0, *(m.a + m.size for m in same)]
        starts = [*(m.a for m in same), len(p)]
        return sum(m.size for m in same) >= share * len(p) and max(b - a for a, b in zip(ends, starts)) <= gap

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="boolean")

    return run(part, whole)


def residues(pairs: DataFrame, words: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, kind, found: what a target keeps of its source's language.

    word: a word of a list (word) that both sides hold, in small letters. title: a heading that stands unchanged in the
    target and holds a word in small letters of that list. Words meet the list by equi-join.
    """
    small = lambda c: F.array_distinct(T.matches(T.prose(F.col(c)), r"(?<![\p{L}\p{N}])\p{Ll}{3,}(?![\p{L}\p{N}])"))
    heads = lambda c: T.matches(T.lines_unix(F.col(c)), r"(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\n]+)$", 1)
    both = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    titles = both.select(key, F.explode(F.array_intersect(heads(source), heads(target))).alias("found"))
    titles = titles.select(key, "found", F.explode(F.array_distinct(T.matches(F.col("found"), r"(?<![\p{L}\p{N}])\p{Ll}{3,}(?![\p{L}\p{N}])"))).alias("word"))
    known = words.select("word").distinct()
    titles = titles.join(known, "word", "left_semi").select(key, F.lit("title").alias("kind"), "found").distinct()
    bare = lambda c: F.regexp_replace(T.lines_unix(F.col(c)), r"(?dm)^[ \t]{0,3}#{1,6}[ \t][^\n]*$", " ")
    own = both.select(key, bare(source).alias("_a"), bare(target).alias("_b"))
    shared = own.select(key, F.explode(F.array_intersect(small("_a"), small("_b"))).alias("word")).join(known, "word", "left_semi")
    return shared.select(key, F.lit("word").alias("kind"), F.col("word").alias("found")).unionByName(titles)


def emphasised(markdown: str) -> list[tuple[str, str]]:
    """(kind, text) of the emphasis of one paragraph, by pairing delimiter runs: the nearest opener that fits is closed first.

    A run opens where no blank follows it and closes where none stands before it; underscores inside words do neither.
    """
    out: list[tuple[int, str, str]] = []
    openers: list[list] = []  # mark, marks left, where its text begins
    i, n = 0, len(markdown)
    while i < n:
        ch = markdown[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "`":
            j = i
            while j < n and markdown[j] == "`":
                j += 1
            end = markdown.find("`" * (j - i), j)
            i = end + (j - i) if end >= 0 else j
            continue
        if ch not in "*_":
            i += 1
            continue
        j = i
        while j < n and markdown[j] == ch:
            j += 1
        before, after = markdown[i - 1 : i], markdown[j : j + 1]
        opens, closes = bool(after) and not after.isspace(), bool(before) and not before.isspace()
        if ch == "_":
            opens, closes = opens and not before.isalnum(), closes and not after.isalnum()
        left = j - i
        while closes and left and (k := next((x for x in range(len(openers) - 1, -1, -1) if openers[x][0] == ch), None)) is not None:
            opener = openers[k]
            size = 2 if left >= 2 and opener[1] >= 2 else 1
            out.append((opener[2] - size, "strong" if size == 2 else "light", markdown[opener[2] : i + (j - i - left)]))
            del openers[k + 1 :]
            left -= size
            opener[1] -= size
            opener[2] -= size
            if not opener[1]:
                openers.pop()
        if opens and left:
            openers.append([ch, left, j])
        i = j
    return [(kind, text) for _, kind, text in sorted(out)]


def emphasis_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, text of each stretch of emphasis of a text; emphasis does not cross a blank line, and code has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, kind, t) for k, m in b.itertuples(index=False) for p in m.split("\n\n") for kind, t in emphasised(p)]
            yield pd.DataFrame(rows, columns=["k", "kind", "text"])

    kind = dict(df.dtypes)[key]
    bare = F.regexp_replace(T.lines_unix(F.col(text)), r"(?dms)^[ \t]{0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)", "\n\n")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), bare.alias("m")).where(F.contains("m", F.lit("*")) | F.contains("m", F.lit("_")))
    return rows.mapInPandas(run, f"k {kind}, kind string, text string").withColumnRenamed("k", key)

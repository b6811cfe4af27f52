"""Two versions of a text against each other: conservation, coverage, alignment, risk, near-duplicates.

Frames hold a unique key, a source and a target text; rows where either is null or blank give nothing unless stated.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import written_values
from .blocks import explode_blocks

LOOK_BACK = 12  # blocks that a near-duplicate may lie back
LONG = 180  # letters of a long block
ALIKE = 0.88  # least similarity of near-duplicates


def multiset(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token, n of each distinct token."""
    return df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def conservation(pairs: DataFrame, key: str, source: Column, target: Column) -> DataFrame:
    """key, token, missing, added: tokens that source and target hold unequally often.

    One pass: both sides are exploded with a sign and summed, instead of joining two count tables.
    """
    both = pairs.select(key, F.explode(F.concat(F.transform(source, lambda x: F.struct(x.alias("token"), F.lit(1).alias("d"))), F.transform(target, lambda x: F.struct(x.alias("token"), F.lit(-1).alias("d"))))).alias("t"))
    d = both.groupBy(key, F.col("t.token").alias("token")).agg(F.sum("t.d").alias("d")).where("d <> 0")
    return d.select(key, "token", F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("added"))


def number_fidelity(pairs: DataFrame, key: str, source: str, target: str, source_language: str, target_language: str) -> DataFrame:
    """key, token, missing, added, explained: numbers that source and target hold unequally often.

    An added plain number is explained where the source writes its value as a word more often than the target does; each
    such word explains one number. Tokens of equal value are explained in alphabetical order.
    """
    numbers = conservation(pairs, key, T.number_tokens(F.col(source)), T.number_tokens(F.col(target)))
    words = lambda c, lang: F.transform(written_values(F.col(c), F.col(lang)), lambda v: v.cast("string"))
    spoken = conservation(pairs, key, words(source, source_language), words(target, target_language)).where("missing > 0")
    value = F.when(F.regexp_like("token", F.lit("^[0-9]{1,9}$")) & (F.col("added") > 0), F.col("token").cast("int").cast("string"))
    x = numbers.withColumn("value", value).join(spoken.select(key, F.col("token").alias("value"), F.col("missing").alias("spoken")), [key, "value"], "left")
    before = F.coalesce(F.sum("added").over(W.partitionBy(key, "value").orderBy("token").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    explained = F.when(F.col("spoken").isNotNull(), F.greatest(F.lit(0), F.least(F.col("added"), F.col("spoken") - before))).otherwise(F.lit(0))
    return x.select(key, "token", "missing", "added", explained.cast("int").alias("explained"))


def coverage(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, source_letters, target_letters, issue: null, short or long.

    From 80 letters on the ratio must lie in .55 to 1.80; from 20 on it may reach 2.50, or 80 letters more.
    """
    s, t = T.letters(F.col(source)), T.letters(F.col(target))
    r = t / s
    issue = F.when((s >= 80) & (r < 0.55), "short").when((s >= 80) & (r > 1.8), "long").when((s >= 20) & (s < 80) & (r > 2.5) & (t > s + 80), "long")
    ok = (F.trim(source) != "") & (F.trim(target) != "")
    return pairs.where(ok).select(key, s.alias("source_letters"), t.alias("target_letters"), issue.alias("issue"))


def align_blocks(pairs: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, position, source_block, target_block: blocks aligned by position; a side without a partner is null."""
    s = explode_blocks(pairs, key, source).withColumnRenamed("block", "source_block")
    t = explode_blocks(pairs, key, target).withColumnRenamed("block", "target_block")
    return s.join(t, [key, "position"], "full_outer")


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Share of matching characters of two texts, 2·matches/total, without junk rules; upper bounds below least give 0."""

    def one(p: str, q: str) -> float:
        m = SequenceMatcher(None, p, q, autojunk=False)
        return 0.0 if m.real_quick_ratio() < least or m.quick_ratio() < least else m.ratio()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y)])

    return ratio(a, b)


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, earlier, similarity: long blocks that nearly repeat one of the LOOK_BACK long blocks before.

    Candidates are neighbours by rank, found by one equi-join on (key, rank); length ratio prunes before similarity.
    """
    b = explode_blocks(df, key, text).withColumn("n", T.letters(F.col("block"))).where(F.col("n") >= LONG)
    b = b.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("position")))
    ahead = b.select(key, F.col("position").alias("earlier"), F.col("block").alias("other"), F.col("n").alias("m"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + LOOK_BACK)).alias("rank"))
    near = b.join(ahead, [key, "rank"]).where((F.least("n", "m") / F.greatest("n", "m")) >= 0.7)
    near = near.withColumn("similarity", F.when(F.col("block") == F.col("other"), F.lit(1.0)).otherwise(similarity(F.col("block"), F.col("other"), ALIKE)))
    near = near.where(F.col("similarity") >= ALIKE)
    first = F.max(F.struct(F.round("similarity", 6).alias("similarity"), F.col("earlier")))
    return near.groupBy(key, "position").agg(first.alias("x")).select(key, "position", "x.earlier", "x.similarity")


def words_of(text: Column) -> Column:
    return T.matches(F.lower(text), r"[\p{L}\p{N}]+")


def protected_terms(text: Column) -> Column:
    """Capitalised or all-capital words that do not open a sentence, sorted."""
    found = T.matches(text, r"[\p{Ll}\p{N},;:)] +(\p{Lu}[\p{L}\p{N}]+)", 1)
    return F.array_sort(found)


def heading_levels_of(text: Column) -> Column:
    """The levels of a text's headings, in order."""
    return F.transform(T.matches(T.lines_unix(text), r"(?m)^[ \t]{0,3}(#{1,6})[ \t]", 1), lambda x: F.length(x))


def breaks_hierarchy(a: Column, b: Column) -> Column:
    """Whether a revision's heading levels (b, after a) jump down by more than one, or go below level 3 where there were no headings."""
    steps = lambda levels: F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda x, y: y - x)
    jumps = lambda levels: F.exists(steps(levels), lambda x: F.coalesce(x > 1, F.lit(False)))
    return (jumps(b) & ~jumps(a)) | ((F.size(a) == 0) & F.coalesce(F.array_max(b) > 3, F.lit(False)))


def word_similarity(a: Column, b: Column) -> Column:
    """Share of words of two texts that match in sequence, 2·matches/total."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, list(p), list(q), autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def revision_risk(pairs: DataFrame, key: str | list[str], before: str, after: str) -> DataFrame:
    """key, risk, reason: the first of the rules that a revision breaks, else low.

    numbers: their multisets differ. structure: a heading level is skipped, or deep headings appear where none were.
    emptied: one side is blank. names: protected terms differ. headings: both are nothing but headings, and differ.
    blocks: their number differs. length: from 8 words on, a ratio outside .8 to 1.25. rewritten: from 10 words on, a
    word similarity below .55; only rows that no other rule hits are compared by words.
    """
    keys = [key] if isinstance(key, str) else key
    a, b = F.col(before), F.col(after)
    na, nb = F.array_sort(T.number_tokens(a)), F.array_sort(T.number_tokens(b))
    wa, wb = F.size(words_of(a)), F.size(words_of(b))
    blocks = lambda c: T.count_of(F.trim(T.lines_unix(c)), r"\n[ \t]*\n[ \t\n]*") + 1
    only = lambda c: ~F.exists(F.split(T.lines_unix(c), "\n"), lambda x: (F.trim(x) != "") & ~F.regexp_like(x, F.lit(r"^[ \t]{0,3}#{1,6}[ \t]")))
    reason = (
        F.when(na != nb, "numbers")
        .when(breaks_hierarchy(heading_levels_of(a), heading_levels_of(b)), "structure")
        .when((F.trim(a) == "") != (F.trim(b) == ""), "emptied")
        .when(protected_terms(a) != protected_terms(b), "names")
        .when(only(a) & only(b) & (F.trim(a) != "") & (T.canonical(a) != T.canonical(b)), "headings")
        .when(blocks(a) != blocks(b), "blocks")
        .when((wa >= 8) & ((wb / wa < 0.8) | (wb / wa > 1.25)), "length")
    )
    x = pairs.where(a.isNotNull() & b.isNotNull()).select(*keys, before, after, reason.alias("reason"))
    open_ = F.col("reason").isNull() & (wa >= 10) & (words_of(a) != words_of(b))
    same = word_similarity(F.when(open_, words_of(a)), F.when(open_, words_of(b)))
    x = x.withColumn("reason", F.coalesce("reason", F.when(same < 0.55, "rewritten")))
    return x.select(*keys, F.when(F.col("reason").isNull(), "low").otherwise("high").alias("risk"), F.coalesce("reason", F.lit("none")).alias("reason"))


def hunks(pairs: DataFrame, key: str | list[str], before: str, after: str, bound: int | None = None) -> DataFrame:
    """key, hunk_no, before_start, before_end, after_start, after_end of line hunks that differ.

    Equal heads and tails are cut first, the rest is matched in sequence, in memory linear in the lines. With a bound,
    more line pairs than it are not matched: equal counts are then compared by place, others are one hunk.
    """
    keys = [key] if isinstance(key, str) else key

    def diff(x: list[str], y: list[str]) -> list[tuple[int, int, int, int]]:
        lo = 0
        while lo < min(len(x), len(y)) and x[lo] == y[lo]:
            lo += 1
        hi = 0
        while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
            hi += 1
        p, q = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not p and not q:
            return []
        if bound is None or len(p) * len(q) <= bound:
            ops = [o[1:] for o in SequenceMatcher(None, p, q, autojunk=False).get_opcodes() if o[0] != "equal"]
        elif len(p) == len(q):
            ops = [(i, i + 1, i, i + 1) for i in range(len(p)) if p[i] != q[i]]
        else:
            ops = [(0, len(p), 0, len(q))]
        return [(a + lo, b + lo, c + lo, d + lo) for a, b, c, d in ops]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [(*k, i, *h) for *k, x, y in t.itertuples(index=False) for i, h in enumerate(diff((x or "").split("\n"), (y or "").split("\n")))]
            yield pd.DataFrame(rows, columns=[*keys, "hunk_no", "before_start", "before_end", "after_start", "after_end"])

    kinds = dict(pairs.dtypes)
    changed = pairs.where(~F.col(before).eqNullSafe(F.col(after))).select(*keys, before, after)
    return changed.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", hunk_no int, before_start int, before_end int, after_start int, after_end int")


def overlap(parts: DataFrame, wholes: DataFrame, part_key: str, key: str, part: str, whole: str) -> DataFrame:
    """part_key, tokens, shared, share: how many distinct words of a part its whole holds.

    Words meet by equi-join on (key, word), so a whole with many parts is sent once, as words.
    """
    p = parts.where(F.col(part).isNotNull()).select(part_key, key, F.explode(F.array_distinct(words_of(F.col(part)))).alias("word"))
    w = wholes.where(F.col(whole).isNotNull()).select(key, F.explode(F.array_distinct(words_of(F.col(whole)))).alias("word")).distinct().withColumn("_in", F.lit(1))
    known = wholes.where(F.col(whole).isNotNull()).select(key).distinct()
    x = p.join(known, key, "left_semi").join(w, [key, "word"], "left").groupBy(part_key).agg(F.countDistinct("word").alias("tokens"), F.countDistinct(F.when(F.col("_in") == 1, F.col("word"))).alias("shared"))
    return x.withColumn("share", F.round(F.col("shared") / F.col("tokens"), 6))

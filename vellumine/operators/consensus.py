"""Words and terms of documents: counts, discovery, spelling outliers, glossaries, repeated lines.

Keys are unique; null texts give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

TERM = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+"
TERMS = 50  # terms kept of a document


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, n: lower-case words of letters."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(T.matches(F.lower(text), r"\p{L}+")).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """word, n, documents over the whole corpus.

    Each text's words are sorted within its row, so that the first of each word counts the text: one shuffle, by word.
    """
    words = F.array_sort(T.matches(F.lower(F.col(text)), r"\p{L}+"))
    x = df.where(F.col(text).isNotNull()).select(words.alias("_w")).where(F.size("_w") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("_w", 1, F.size("_w") - 1))  # each word's neighbour in the sorted array
    x = x.select(F.explode(F.arrays_zip(F.col("_w").alias("word"), before.alias("before"))).alias("x"))
    return x.groupBy(F.col("x.word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.word") != F.col("x.before")).alias("documents"))


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n: names of several capitalised words seen at least twice; their commonest spelling, TERMS at most.

    Ties between spellings go to the alphabetically first; terms are ranked by count, length, text.
    """
    t = df.where(F.col(text).isNotNull()).select(key, F.explode(T.matches(T.prose(F.col(text)), TERM)).alias("term")).where(F.length("term") <= 80)
    spelt = t.groupBy(key, F.lower("term").alias("low"), "term").agg(F.count(F.lit(1)).alias("n"))
    best = spelt.groupBy(key, "low").agg(F.sum("n").alias("n"), F.min_by("term", F.struct((-F.col("n")).alias("a"), F.col("term"))).alias("term")).where("n >= 2")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("term")), "term"))
    return best.withColumn("rank", rank).where(F.col("rank") <= TERMS).select(key, "term", "n")


def spelling_outliers(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, word, right: capitalised words of 7 letters or more seen once, one edit from exactly one word seen 4 times or more.

    An edit is a letter more, less or other, or two neighbours that changed places. Pairs meet by equi-join on document,
    first three and last two letters.
    """
    w = df.where(F.col(text).isNotNull()).select(key, F.explode(T.matches(F.col(text), r"\p{Lu}\p{L}{6,}")).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    w = w.withColumn("edge", F.concat(F.lower(F.substring("word", 1, 3)), F.lower(F.expr("right(word, 2)"))))
    rare = w.where("n = 1").select(key, "edge", "word")
    good = w.where("n >= 4").select(key, "edge", F.col("word").alias("right"))
    low, other = F.lower("word"), F.lower("right")
    swapped = F.exists(
        F.sequence(F.lit(1), F.length("word") - 1),
        lambda i: F.concat(F.substr(low, F.lit(1), i - 1), F.substr(low, i + 1, F.lit(1)), F.substr(low, i, F.lit(1)), F.substr(low, i + 2)) == other,
    )
    near = rare.join(good, [key, "edge"]).where((F.levenshtein(low, other) == 1) | ((F.length("word") == F.length("right")) & (low != other) & swapped))
    return near.groupBy(key, "word").agg(F.min("right").alias("right"), F.count(F.lit(1)).alias("_k")).where("_k = 1").select(key, "word", "right")


#: What no glossary term is looked for in: fences, code, addresses, tags and the targets of links.
_OUTSIDE = (r"(?dms)^[ \t]{0,3}(`{3,}|~{3,})[^\n]*$.*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)", r"`[^`\n]+`", r"\]\([^)\n]*\)", r"https?://[^ \t\n)>]+", r"</?[A-Za-z][^<>\n]*>")
#: Letters, digits and marks of scripts that set blanks between words.
_INSIDE = r"[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]"


def whole_words(text: Column, terms: Column) -> Column:
    """Which of the terms a text holds as whole words, lower-case: the longest first, so that none is found inside another.

    Terms are plain text, not patterns. Scripts without blanks have no word edges.
    """
    for p in _OUTSIDE:
        text = F.regexp_replace(text, p, " ")
    known = F.array_distinct(F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != "")))
    order = F.array_sort(F.transform(known, lambda t: F.named_struct(F.lit("a"), -F.length(t), F.lit("t"), t)))
    quoted = F.transform(order, lambda x: F.concat(F.lit("\\Q"), F.replace(x.t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit(f"(?<!{_INSIDE})("), F.array_join(quoted, "|"), F.lit(f")(?!{_INSIDE})"))
    return F.when(F.size(known) > 0, F.array_distinct(F.regexp_extract_all(F.lower(text), pattern, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def glossary_hits(cases: DataFrame, key: str, source: str, target: str, glossary: str) -> DataFrame:
    """key, term, wanted, in_target: glossary entries whose term a source holds as a whole word, and whether its target has the wanted one.

    Rows that are equal count once. Everything happens inside the row; nothing is shuffled but for that.
    """
    g = cases.where(F.col(glossary).isNotNull() & F.col(source).isNotNull()).select(key, source, target, glossary).distinct()
    inside = whole_words(F.col(source), F.transform(glossary, lambda x: x["source"]))
    wanted = whole_words(F.coalesce(F.col(target), F.lit("")), F.transform(glossary, lambda x: x["target"]))
    x = g.select(key, inside.alias("_s"), wanted.alias("_t"), F.explode(F.array_distinct(glossary)).alias("g"))
    x = x.where(F.array_contains("_s", F.lower(F.trim("g.source"))))
    has = F.coalesce(F.array_contains("_t", F.lower(F.trim("g.target"))), F.lit(False))
    return x.select(key, F.col("g.source").alias("term"), F.col("g.target").alias("wanted"), has.alias("in_target")).distinct()


def glossary_duplicates(cases: DataFrame, key: str, glossary: str) -> DataFrame:
    """key, term, n: terms that a glossary lists more than once, without regard to case."""
    g = cases.where(F.col(glossary).isNotNull()).select(key, F.explode(glossary).alias("g")).select(key, F.lower("g.source").alias("term"))
    return g.where("term is not null").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_lines(pages: DataFrame, group: str, page: str, text: str, least: int = 3) -> DataFrame:
    """group, line, pages: first and last lines that repeat on at least so many pages, without their numbers."""
    lines = F.filter(F.split(T.lines_unix(F.col(text)), "\n"), lambda x: F.trim(x) != "")
    edge = F.array_distinct(F.array(F.get(lines, F.lit(0)), F.get(lines, F.size(lines) - 1)))
    flat = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]+", " "), r"[ \t]+", " "))
    x = pages.where(F.col(text).isNotNull()).select(group, page, F.explode(F.array_distinct(F.transform(F.filter(edge, lambda e: e.isNotNull()), flat))).alias("line"))
    return x.where("line <> ''").groupBy(group, "line").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def duplicate_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id, copies: documents of equal canonical text; class_id is the least key among them.

    One row per document: class sizes are joined back by hash, not by listing members, so a class may be of any size.
    """
    h = df.where(F.col(text).isNotNull()).select(key, F.sha2(T.canonical(F.col(text)), 256).alias("h"))
    c = h.groupBy("h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return h.join(c, "h").select(key, "class_id", "copies")

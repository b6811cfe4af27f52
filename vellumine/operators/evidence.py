"""Evidence inside and between texts: contents lists, written numbers, untranslated sentences, token consensus, emphasis, recovery.

Null texts give nothing; keys are unique.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import written_values
from .blocks import explode_blocks, role

#: Headings of contents lists (fixed values).
CONTENTS = ("contents", "table of contents", "contenido", "índice", "contenidos", "sommaire", "table des matières", "inhalt", "inhaltsverzeichnis", "conteúdo", "sumário", "sommario", "indice", "содержание", "оглавление", "目录", "目次", "المحتويات", "สารบัญ", "विषय-सूची")

def written_numbers(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, value, n of each number that a text writes in words of its language, compounds included."""
    values = written_values(F.col(text), F.col(language))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))


def contents_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, entry_no, label: the linked entries of the lists that follow a heading of contents."""
    b = explode_blocks(df, key, text)
    order = W.partitionBy(key).orderBy("position")
    title = F.trim(F.regexp_replace(F.lower(F.lag("block").over(order)), r"^[ \t]{0,3}#{1,6}[ \t]+", ""))
    lists = b.withColumn("role", role(F.col("block"))).withColumn("title", title).where((F.col("role") == "list") & F.col("title").isin(*CONTENTS))
    labels = T.matches(F.col("block"), r"\[([^\]\n]+)\]\(", 1)
    return lists.select(key, "position", F.posexplode(labels).alias("i", "label")).select(key, (F.row_number().over(W.partitionBy(key).orderBy("position", "i")) - 1).alias("entry_no"), "label")


def match_titles(entries: DataFrame, titles: DataFrame, key: str, number: str) -> DataFrame:
    """key, entry_no, label, number: entries with the one title of the same key that is equal but for case and blanks; null where none or several are."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t]+", " "))
    t = titles.where("title is not null").groupBy(key, flat(F.col("title")).alias("flat")).agg(F.min(number).alias(number), F.count(F.lit(1)).alias("_k")).where("_k = 1").drop("_k")
    return entries.withColumn("flat", flat(F.col("label"))).join(t, [key, "flat"], "left").select(key, "entry_no", "label", number)


def match_near_titles(entries: DataFrame, titles: DataFrame, key: str, number: str, least: float = 0.96, ahead: float = 0.02) -> DataFrame:
    """key, entry_no, label, number, score: entries with the one title of the same key that they are nearly equal to.

    Both hold the same numbers and differ by at most two edits; the score, one less the share of edits, is at least
    `least`, and no other title comes within `ahead` of it. Nulls where none is such. Two edits leave one of a title's
    three parts whole, moved by two places at most, so pairs meet by equi-join on (key, length, part).
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t]+", " "))
    third = lambda n: F.floor(n / 3).cast("int")
    size = lambda n, i: F.when(i < 2, third(n)).otherwise(n - 2 * third(n))
    t = titles.where("title is not null").select(key, F.col(number), flat(F.col("title")).alias("t")).where(F.length("t") >= 6).withColumn("n", F.length("t"))
    t = t.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("part", F.expr("substr(t, i * cast(floor(n / 3) as int) + 1, if(i < 2, cast(floor(n / 3) as int), n - 2 * cast(floor(n / 3) as int)))"))
    e = entries.select(key, "entry_no", flat(F.col("label")).alias("e")).where(F.length("e") >= 6)
    e = e.withColumn("n", F.explode(F.sequence(F.length("e") - 2, F.length("e") + 2))).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("o", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    e = e.withColumn("at", F.col("i") * third(F.col("n")) + F.col("o")).where("at >= 0").withColumn("part", F.substr(F.col("e"), F.col("at") + 1, size(F.col("n"), F.col("i"))))
    pairs = e.select(key, "entry_no", "e", "n", "i", "part").distinct().join(t, [key, "n", "i", "part"]).select(key, "entry_no", "e", "t", number).distinct()
    same = F.array_sort(T.number_tokens(F.col("e"))) == F.array_sort(T.number_tokens(F.col("t")))
    d = F.levenshtein("e", "t", 2)
    pairs = pairs.where(same & (d >= 0)).withColumn("score", 1 - d / F.greatest(F.length("e"), F.length("t"))).where(F.col("score") >= least)
    order = W.partitionBy(key, "entry_no").orderBy(F.desc("score"), number)
    best = pairs.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).where("_k = 1").where(F.coalesce(F.col("_next") < F.col("score") - ahead, F.lit(True)))
    return entries.join(best.select(key, "entry_no", number, F.round("score", 6).alias("score")), [key, "entry_no"], "left").select(key, "entry_no", "label", number, "score")


def untranslated(pairs: DataFrame, key: str, source: str, target: str, least: int = 24) -> DataFrame:
    """key, sentence: source sentences of at least so many letters that the target holds unchanged."""
    sentences = T.matches(T.lines_unix(F.col(source)), r"[^.!?…\n]+[.!?…]")
    x = pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(key, F.explode(F.array_distinct(sentences)).alias("s"), F.col(target).alias("_t"))
    x = x.withColumn("sentence", F.trim("s")).where(T.letters(F.col("sentence")) >= least)
    return x.where(F.contains(F.col("_t"), F.col("sentence"))).select(key, "sentence").distinct()


def _shortened(word: Column) -> Column:
    """A word and what is left of it without one of its letters: words one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def token_consensus(parts: DataFrame, wholes: DataFrame, part_key: str, key: str, part: str, whole: str, support: int = 3) -> DataFrame:
    """part_key, token, right: words of a part that its whole lacks, one edit from exactly one word that the whole has often.

    Words of 5 letters or more of any script. Pairs meet by equi-join on what is left of both without one letter.
    """
    words = lambda c: T.matches(F.lower(c), r"\p{L}{5,}")
    w = wholes.where(F.col(whole).isNotNull()).select(key, F.explode(words(F.col(whole))).alias("right")).groupBy(key, "right").agg(F.count(F.lit(1)).alias("n"))
    p = parts.where(F.col(part).isNotNull()).select(part_key, key, F.explode(F.array_distinct(words(F.col(part)))).alias("token")).distinct()
    p = p.join(w.select(key, F.col("right").alias("token")), [key, "token"], "left_anti")
    near = p.withColumn("e", F.explode(_shortened(F.col("token")))).join(w.where(F.col("n") >= support).withColumn("e", F.explode(_shortened(F.col("right")))), [key, "e"])
    near = near.where(F.levenshtein("token", "right", 1) == 1)
    return near.groupBy(part_key, "token").agg(F.min("right").alias("right"), F.countDistinct("right").alias("_k")).where("_k = 1").select(part_key, "token", "right")


def emphasis(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, strong, light, code: spans of double marks, single marks and backticks on one line."""
    t = T.lines_unix(F.col(text))
    strong = T.count_of(t, r"\*\*[^*\n]+\*\*")
    rest = F.regexp_replace(t, r"\*\*[^*\n]+\*\*", " ")
    return df.where(F.col(text).isNotNull()).select(key, strong.alias("strong"), T.count_of(rest, r"\*[^* \t\n][^*\n]*\*").alias("light"), T.count_of(t, r"`[^`\n]+`").alias("code"))


def merge_glossaries(entries: DataFrame, key: str, rows: int = 50) -> DataFrame:
    """key, term, wanted: entries (key, priority, term, wanted) once for each term without regard to case, the least priority first, at most rows of each key."""
    low = F.lower(F.trim("term"))
    best = entries.where("term is not null and trim(term) <> ''").groupBy(key, low.alias("low")).agg(F.min(F.struct("priority", "term", "wanted")).alias("v"))
    r = F.row_number().over(W.partitionBy(key).orderBy("v.priority", "low"))
    return best.withColumn("r", r).where(F.col("r") <= rows).select(key, "v.term", "v.wanted")


def glyph_readings(token: Column) -> Column:
    """Every number that a token of misread digits can mean, sorted: S is 5 or 8, I, i, l are 1, O, o are 0, H, h, n are 11."""
    means = F.create_map(*[x for k, v in {"I": ["1"], "i": ["1"], "l": ["1"], "O": ["0"], "o": ["0"], "S": ["5", "8"], "s": ["5", "8"], "B": ["8"], "H": ["11"], "h": ["11"], "n": ["11"], **{d: [d] for d in "0123456789"}}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(means[c], lambda x: F.concat(a, x))))
    return F.when(F.regexp_like(token, F.lit("^[0-9IiLlOoSsBHhn]{1,7}$")) & ~F.contains(token, F.lit("L")), F.array_sort(F.array_distinct(F.aggregate(chars, F.array(F.lit("")), grow))))


def complete_items(text: Column) -> Column:
    """The whole items of a JSON array that may break off, each as JSON; an empty array where there is none."""

    def items(s: str | None) -> list[str]:
        out, decoder = [], json.JSONDecoder()
        at = (s or "").find("[")
        if at < 0:
            return out
        at += 1
        while True:
            while at < len(s) and s[at] in " \t\r\n,":
                at += 1
            try:
                value, at = decoder.raw_decode(s, at)
            except ValueError:
                return out
            if at >= len(s) and not isinstance(value, dict | list):
                return out
            out.append(json.dumps(value, ensure_ascii=False))

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(items)

    return run(text)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, all rules in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(~ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")

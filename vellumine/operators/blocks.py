"""Markdown blocks, headings, tables and chapters as rows; JVM-side throughout.

Inputs are frames with a unique key and a text column. Null and empty texts give no rows. Fences count: blank lines
and headings inside fenced code part nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

FENCE = r"^[ \t]{0,3}(?:```|~~~)"


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line, fenced: whether the line is in fenced code or is one of its marks."""
    lines = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.posexplode(F.split(T.lines_unix(F.col(text)), "\n")).alias("line_no", "line"))
    order = W.partitionBy(key).orderBy("line_no")
    mark = F.regexp_like("line", F.lit(FENCE))
    before = F.coalesce(F.sum(mark.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("fenced", mark | (before % 2 == 1))


def explode_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, position (from 0), block: pieces between blank lines outside fences."""
    lines = explode_lines(df, key, text)
    order = W.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("blank", ~F.col("fenced") & (F.regexp_replace("line", r"[ \t\f]", "") == ""))
    starts = ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True))
    lines = lines.withColumn("position", F.sum(starts.cast("int")).over(order) - 1).where(~F.col("blank"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key, "position").agg(F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("block"))


def with_ids(blocks: DataFrame, key: str) -> DataFrame:
    """The blocks with ordinal, their count among equal blocks before them, and block_id, stable under insertions elsewhere."""
    content = F.sha2(F.col("block"), 256)
    ordinal = F.row_number().over(W.partitionBy(key, content).orderBy("position")) - 1
    b = blocks.withColumn("ordinal", ordinal)
    return b.withColumn("block_id", F.substring(F.sha2(F.concat_ws("|", F.lit("block-1"), content, F.col("ordinal")), 256), 1, 20))


def role(block: Column) -> Column:
    """First match of: provenance, code, image, table, note, heading, list, quote, body."""
    like = lambda p: F.regexp_like(block, F.lit(p))
    return (
        F.when(like(r"^[ \t]*<!--"), "provenance")
        .when(like(FENCE), "code")
        .when(like(r"^[ \t]*!\[[^\]]*\]\([^)]*\)[ \t]*$"), "image")
        .when(like(r"(?dm)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$"), "table")
        .when(like(r"^[ \t]*(?:Note|Notes|Nota|Notas|Hinweis|Remarque)[ \t]*[:.]"), "note")
        .when(like(r"^[ \t]{0,3}#{1,6}[ \t]"), "heading")
        .when(like(r"^[ \t]{0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]"), "list")
        .when(like(r"^[ \t]*>"), "quote")
        .otherwise("body")
    )


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, heading_no (from 0), line_no, level, title of every heading outside fences."""
    lines = explode_lines(df, key, text).where(~F.col("fenced") & F.regexp_like("line", F.lit(r"^[ \t]{0,3}#{1,6}[ \t]")))
    h = lines.select(
        key,
        "line_no",
        F.length(F.regexp_extract("line", r"^[ \t]{0,3}(#{1,6})", 1)).alias("level"),
        F.trim(F.regexp_replace(F.regexp_replace("line", r"^[ \t]{0,3}#{1,6}[ \t]+", ""), r"[ \t]#+[ \t]*$", "")).alias("title"),
    )
    return h.withColumn("heading_no", F.row_number().over(W.partitionBy(key).orderBy("line_no")) - 1)


def outline(heads: DataFrame, key: str) -> DataFrame:
    """The headings with parent_no, the nearest heading before that is of a higher rank; null at the top.

    The levels are six, so the parent is the latest of at most five running values: no self-join.
    """
    order = W.partitionBy(key).orderBy("heading_no").rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("heading_no"))).over(order) for k in range(1, 7)]
    h = heads.select("*", *[c.alias(f"_l{k}") for k, c in enumerate(last, 1)])
    parent = F.greatest(F.lit(-1), *[F.when(F.col("level") > k, F.coalesce(F.col(f"_l{k}"), F.lit(-1))).otherwise(-1) for k in range(1, 7)])
    return h.withColumn("parent_no", F.when(parent >= 0, parent)).drop(*[f"_l{k}" for k in range(1, 7)])


def chapters(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chapter_no (0: before the first), start_line, lines, chapter: cut at the highest rank of heading seen at least twice.

    The chapters of a text, joined by line ends, are the text again.
    """
    lines = explode_lines(df, key, text)
    level = F.when(~F.col("fenced") & F.regexp_like("line", F.lit(r"^[ \t]{0,3}#{1,6}[ \t]")), F.length(F.regexp_extract("line", r"^[ \t]{0,3}(#{1,6})", 1)))
    lines = lines.withColumn("level", level)
    whole = W.partitionBy(key)
    counts = [F.count(F.when(F.col("level") == k, 1)).over(whole) for k in range(1, 7)]
    cut = F.coalesce(*[F.when(c >= 2, F.lit(k)) for k, c in enumerate(counts, 1)])
    lines = lines.withColumn("cut", cut)
    opens = F.coalesce(F.col("level") == F.col("cut"), F.lit(False)).cast("int")
    lines = lines.withColumn("chapter_no", F.sum(opens).over(whole.orderBy("line_no")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key, "chapter_no").agg(F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("chapter"))


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no (from 0), rows, columns: runs of piped lines with a divider in second place, divider not counted."""
    lines = explode_lines(df, key, text)
    order = W.partitionBy(key).orderBy("line_no")
    piped = ~F.col("fenced") & F.regexp_like("line", F.lit(r"^[ \t]*\|.*\|[ \t]*$"))
    lines = lines.withColumn("piped", piped)
    starts = F.col("piped") & ~F.coalesce(F.lag("piped").over(order), F.lit(False))
    runs = lines.withColumn("run", F.sum(starts.cast("int")).over(order)).where("piped")
    cells = F.size(F.split(F.regexp_replace("line", r"^[ \t]*\||\|[ \t]*$", ""), r"\|"))
    divider = F.regexp_like("line", F.lit(r"^[ \t]*\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*$"))
    t = runs.groupBy(key, "run").agg(F.min("line_no").alias("line_no"), (F.count(F.lit(1)) - F.count_if(divider)).alias("rows"), F.max(cells).alias("columns"), F.count_if(divider).alias("dividers"))
    t = t.where("dividers >= 1").withColumn("table_no", F.row_number().over(W.partitionBy(key).orderBy("line_no")) - 1)
    return t.select(key, "table_no", F.col("rows").cast("bigint").alias("rows"), "columns")


def ledger(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the counts of headings, images, links, list items, quote lines, table lines, comments and fences of a text."""
    t = T.lines_unix(F.col(text))
    n = lambda p: T.count_of(t, p)
    return df.where(F.col(text).isNotNull()).select(
        key,
        n(r"(?m)^[ \t]{0,3}#{1,6}[ \t]").alias("headings"),
        n(r"!\[[^\]\n]*\]\([^)\n]*\)").alias("images"),
        (n(r"\[[^\]\n]*\]\([^)\n]*\)") - n(r"!\[[^\]\n]*\]\([^)\n]*\)")).alias("links"),
        n(r"(?m)^[ \t]{0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]").alias("list_items"),
        n(r"(?m)^[ \t]{0,3}>").alias("quote_lines"),
        n(r"(?m)^[ \t]*\|").alias("table_lines"),
        n(r"<!--").alias("comments"),
        n(r"(?m)^[ \t]{0,3}```").alias("fence_marks"),
    )


def ledger_findings(expected: DataFrame, actual: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, field, expected, actual where actual has fewer than expected; more is allowed."""
    e = expected.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("expected")) for f in fields])).alias("e"))
    a = actual.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("actual")) for f in fields])).alias("a"))
    both = e.select(key, "e.*").join(a.select(key, "a.*"), [key, "field"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where("actual < expected").distinct()


def page_fill(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, page: the page that the last page mark before a line gives (an as-of join by forward fill)."""
    lines = explode_lines(df, key, text)
    page = F.regexp_extract("line", r"^[ \t]*<!-- page ([0-9]{1,6}) -->", 1)
    lines = lines.withColumn("mark", F.when(page != "", page.cast("int")))
    order = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.select(key, "line_no", "line", F.last("mark", ignorenulls=True).over(order).alias("page"))


def plan_chunks(blocks: DataFrame, key: str, size: int = 4000, values: int = 16) -> DataFrame:
    """key, position, chunk_no, chars: blocks packed greedily, in order, into chunks.

    A chunk holds at most size characters and at most so many numbers, signs and addresses that must be conserved. A
    heading and a table stand alone, and so does a block above the size. Only lengths and counts of a text's blocks
    are put together, and folded once.
    """
    kept = T.count_of(F.col("block"), T.NUMBER) + T.count_of(F.col("block"), T.SYMBOL) + T.count_of(F.col("block"), r"https?://")
    alone = role(F.col("block")).isin("heading", "table")
    facts = F.array_sort(F.collect_list(F.struct("position", F.length("block").alias("n"), kept.alias("v"), alone.alias("alone"))))

    @F.pandas_udf("array<int>")
    def fold(rows: pd.Series) -> pd.Series:
        def chunks(items: list) -> list[int]:
            out, chunk, used, held, closed = [], -1, 0, 0, True
            for x in items:
                if closed or x["alone"] or used + x["n"] + 2 > size or held + x["v"] > values:
                    chunk, used, held = chunk + 1, -2, 0
                used, held, closed = used + x["n"] + 2, held + x["v"], bool(x["alone"])
                out.append(chunk)
            return out

        return rows.map(chunks)

    packed = blocks.groupBy(key).agg(facts.alias("b")).withColumn("c", fold("b"))
    return packed.select(key, F.explode(F.arrays_zip(F.col("b.position").alias("position"), F.col("c").alias("chunk_no"), F.col("b.n").alias("chars"))).alias("p")).select(key, "p.*")

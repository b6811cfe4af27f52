"""Pages, lines and boxes: margins, sizes, order, joining, tables.

Lines: doc_id, page, line_no, page_width, page_height, text, x0, x1, top, bottom, font_size, bold. Boxes: x0, x1, top,
bottom. Rows with null geometry give nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

CELL = 64.0  # edge of the grid cells that block box joins


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the commonest font size, each line counting its length up to 100; ties go to the smaller."""
    s = lines.where("font_size is not null").groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.sum(F.least(F.length("text"), F.lit(100))).alias("n"))
    return s.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def heading_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, size, level: the four largest sizes of at least 1.18 times the body."""
    s = lines.select("doc_id", F.round("font_size", 1).alias("size")).distinct().join(body_size(lines), "doc_id").where(F.col("size") >= 1.18 * F.col("body"))
    return s.withColumn("level", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.desc("size")))).where("level <= 4").select("doc_id", "size", "level")


def margin_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"([0-9])[ \t]+(?=[0-9])", "$1")


def _at_edge() -> Column:
    """Lines in the top tenth or the bottom sixth of their page, and short ones in capitals in its top 18 in a hundred."""
    upper = (F.col("top") <= 0.18 * F.col("page_height")) & (F.length("text") <= 80) & T.upper_case(F.col("text"))
    return (F.col("top") <= 0.1 * F.col("page_height")) | (F.col("bottom") >= 0.84 * F.col("page_height")) | upper


def margin_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """The lines at the edge of their page whose key stands on at least so many pages."""
    edge = lines.where(_at_edge()).withColumn("key", margin_key(F.col("text"))).where("key <> ''")
    strong = edge.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= least).select("doc_id", "key")
    return edge.join(strong, ["doc_id", "key"], "left_semi").select("doc_id", "page", "line_no", "key")


def folios(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, folio: margin numbers, misread digits included, whose offset from the page is confirmed on two pages by clean ones."""
    c = lines.where(_at_edge()).select("doc_id", "page", "line_no", F.trim("text").alias("t")).withColumn("folio", T.confusable_digits(F.col("t"))).where("folio is not null").withColumn("offset", F.col("folio") - F.col("page"))
    ok = c.where(F.regexp_like("t", F.lit("^[0-9]+$"))).groupBy("doc_id", "offset").agg(F.countDistinct("page").alias("n")).where("n >= 2").select("doc_id", "offset")
    return c.join(ok, ["doc_id", "offset"], "left_semi").select("doc_id", "page", "line_no", "folio")


def box_pairs(left: DataFrame, right: DataFrame, by: list[str], share: float = 0.0) -> DataFrame:
    """Pairs of boxes on the same page that overlap by more than a share of the smaller: l_* and r_* columns.

    Boxes are laid on a grid; pairs meet by equi-join on page and cell, and once, in the cell of their common corner.
    """

    def gridded(df: DataFrame, p: str) -> DataFrame:
        cells = lambda a, b: F.sequence(F.floor(F.col(a) / CELL).cast("int"), F.floor(F.col(b) / CELL).cast("int"))
        g = df.where("x0 is not null and x1 is not null and top is not null and bottom is not null and x1 >= x0 and bottom >= top")
        g = g.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("top", "bottom")))
        return g.select(*by, "_cx", "_cy", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])

    j = gridded(left, "l").join(gridded(right, "r"), [*by, "_cx", "_cy"])
    x0, x1 = F.greatest("l_x0", "r_x0"), F.least("l_x1", "r_x1")
    y0, y1 = F.greatest("l_top", "r_top"), F.least("l_bottom", "r_bottom")
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_bottom") - F.col(f"{p}_top"))
    common = (x1 - x0) * (y1 - y0)
    j = j.where((x1 > x0) & (y1 > y0) & (F.floor(x0 / CELL) == F.col("_cx")) & (F.floor(y0 / CELL) == F.col("_cy")))
    return j.where(common > share * F.least(area("l"), area("r"))).drop("_cx", "_cy")


def dedupe_characters(chars: DataFrame, share: float = 0.5) -> DataFrame:
    """The characters, one of each pile: equal text, font, uprightness and rounded size, overlapping by a share of the smaller.

    Characters of a line are joined, by top and left edge, to the first pile that any of whose members they overlap; the
    one nearest to the pile's median place stays, in a tie the first. Lines are small groups whatever the corpus.
    """
    order = ["line_no", "char_no"]

    def thin(t: pd.DataFrame) -> pd.DataFrame:
        keep: list[int] = []
        boxes = t[["x0", "x1", "top", "bottom"]].to_numpy(float)
        kinds = list(zip(t["text"], t["font"], t["upright"], t["size"].round(2)))
        piles: dict[tuple, list[list[int]]] = {}
        for i in sorted(range(len(t)), key=lambda i: (boxes[i][2], boxes[i][0], i)):
            for pile in piles.setdefault(kinds[i], []):
                if any(_covers(boxes[i], boxes[j]) >= share for j in pile):
                    pile.append(i)
                    break
            else:
                piles[kinds[i]].append([i])
        for groups in piles.values():
            for pile in groups:
                mid = np.median(boxes[pile], axis=0)
                keep.append(min(pile, key=lambda i: (round(float(np.abs(boxes[i] - mid).sum()), 6), i)))
        return t.iloc[sorted(keep)]

    clean = chars.where("x0 is not null and x1 is not null and top is not null and bottom is not null")
    return clean.sort(*order).groupBy("doc_id", "page", "line_no").applyInPandas(lambda t: thin(t.sort_values(order)), chars.schema)


def _covers(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller of two boxes that both cover."""
    w, h = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
    least = min((a[1] - a[0]) * (a[3] - a[2]), (b[1] - b[0]) * (b[3] - b[2]))
    return w * h / least if w > 0 and h > 0 and least > 0 else 0.0


def page_quality(lines: DataFrame) -> DataFrame:
    """doc_id, page, quality: the score of a page's text, less for short broken lines and for turned ones.

    lines: doc_id, page, line_no, text, rotated. Lines of at most two letters cost up to .30, turned ones up to .25.
    """
    x = lines.where(F.trim("text") != "").withColumn("_n", T.letters(F.col("text"))).withColumn("_l", F.struct("line_no", "text"))
    g = x.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda s: s.text), "\n").alias("t"),
        (F.count_if((F.col("_n") > 0) & (F.col("_n") <= 2)) / F.greatest(F.lit(1), F.count_if(F.col("_n") > 0))).alias("short"),
        (F.count_if(F.coalesce("rotated", F.lit(False))) / F.count(F.lit(1))).alias("turned"),
    )
    score = T.quality(F.col("t")) - F.least(F.lit(0.30), 0.35 * F.col("short")) - F.least(F.lit(0.25), 0.4 * F.col("turned"))
    return g.select("doc_id", "page", F.round(F.greatest(F.lit(0.0), score), 6).alias("quality"))


def accepted_tables(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_no of the tables that count: two rows, two columns, four filled cells, a box inside the page.

    tables: doc_id, page, table_no, x0, top, x1, bottom, page_width, page_height, rows.
    """
    filled = F.size(F.filter(F.flatten("rows"), lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    inside = (F.col("x0") >= 0) & (F.col("top") >= 0) & (F.col("x1") <= F.col("page_width")) & (F.col("bottom") <= F.col("page_height")) & (F.col("x1") > F.col("x0")) & (F.col("bottom") > F.col("top"))
    return tables.where((F.size("rows") >= 2) & (width >= 2) & (filled >= 4) & inside).select("doc_id", "page", "table_no")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, paragraph_no, text: lines joined where gap, indent and end of sentence do not part them; hyphens at line ends join words."""
    w = W.partitionBy("doc_id", "page").orderBy("line_no")
    x = lines.where("top is not null and trim(text) <> ''")
    x = x.select("*", (F.col("top") - F.lag("bottom").over(w)).alias("gap"), F.lag("text").over(w).alias("before"), (F.col("x0") - F.lag("x0").over(w)).alias("indent"), F.lag("font_size").over(w).alias("size_before"))
    ended = F.regexp_like("before", F.lit(r"[.!?:;]['\")”»]*[ \t]*$"))
    breaks = F.col("before").isNull() | (F.col("gap") > 1.15 * F.col("font_size")) | (ended & (F.col("indent") > 0.8 * F.col("font_size"))) | (F.abs(F.col("font_size") - F.col("size_before")) > 0.35 * F.col("font_size"))
    x = x.withColumn("paragraph_no", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(w) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: F.trim(s.text))
    joined = x.groupBy("doc_id", "page", "paragraph_no").agg(F.array_join(parts, "\n").alias("t"))
    return joined.select("doc_id", "page", "paragraph_no", F.regexp_replace(F.regexp_replace("t", r"(\p{L})[-­]\n(?=\p{Ll})", "$1"), r"\n", " ").alias("text"))


def reading_order(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, order_no: bands between full-width lines, columns inside a band, then top to bottom.

    One page is one group; a page's lines are few whatever the corpus.
    """

    def columns(rows: list[tuple], width: float) -> list[tuple]:
        starts = sorted({r[1] for r in rows})
        cuts = [b for a, b in zip(starts, starts[1:]) if b - a >= 0.12 * width]
        if not 1 <= len(cuts) <= 3:
            return sorted(rows, key=lambda r: (r[3], r[1], r[0]))
        col = lambda r: sum(r[1] >= c for c in cuts)
        groups = [[r for r in rows if col(r) == k] for k in range(len(cuts) + 1)]
        crossing = sum(any(r[1] < c < r[2] - 0.02 * width for c in cuts) for r in rows)
        if min(map(len, groups)) < 3 or crossing > max(1, 0.08 * len(rows)):
            return sorted(rows, key=lambda r: (r[3], r[1], r[0]))
        return [r for g in groups for r in sorted(g, key=lambda r: (r[3], r[1], r[0]))]

    def page(t: pd.DataFrame) -> pd.DataFrame:
        width = float(t["page_width"].iloc[0])
        rows = sorted(t[["line_no", "x0", "x1", "top"]].itertuples(index=False, name=None), key=lambda r: (r[3], r[1], r[0]))
        out: list[tuple] = []
        band: list[tuple] = []
        for r in rows:
            if r[2] - r[1] >= 0.58 * width:
                out += columns(band, width) if band else []
                out.append(r)
                band = []
            else:
                band.append(r)
        out += columns(band, width) if band else []
        return pd.DataFrame({"doc_id": t["doc_id"].iloc[0], "page": t["page"].iloc[0], "line_no": [r[0] for r in out], "order_no": range(len(out))})

    clean = lines.where("x0 is not null and x1 is not null and top is not null and page_width is not null")
    return clean.select("doc_id", "page", "page_width", "line_no", "x0", "x1", "top").groupBy("doc_id", "page").applyInPandas(page, "doc_id bigint, page int, line_no int, order_no int")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """doc_id, page, quality, needs: pages whose text layer cannot be trusted.

    They are damaged, hold a table that is not reliable, a part-page image, a full image over little text, numbers made
    of letters, or text of low quality. pages: doc_id, page, text, image_ratio (largest image by page area, null for
    none); table_reliable where known.
    """
    text = F.coalesce("text", F.lit(""))
    q, n = T.quality(text), T.letters(text)
    image = F.coalesce("image_ratio", F.lit(0.0))
    table = ~F.coalesce("table_reliable", F.lit(True)) if "table_reliable" in pages.columns else F.lit(False)
    glyphs = T.count_of(text, r"(?:^|[^\p{L}\p{N}])(?:[0-9]+[IlOoS][0-9IlOoS]*|[IlOoS]+[0-9][0-9IlOoS]*)(?:$|[^\p{L}\p{N}])") >= 2
    needs = table | T.damaged(text) | glyphs | ((image >= 0.05) & (image < 0.85)) | ((image >= 0.85) & (n < 40)) | (((n > 0) | (image > 0)) & (q < 0.48))
    return pages.select("doc_id", "page", q.alias("quality"), needs.alias("needs"))


def replaced_by_ocr(pages: DataFrame) -> DataFrame:
    """doc_id, page, replace: whether a second reading takes the place of a page's own text.

    pages: doc_id, page, native, scanned, has_table. Pages with a table need nearly as good a reading; pages with hardly
    a letter take any fair one; damaged pages need most of the letters and a better score; poor ones a clearly better.
    """
    a, b = F.coalesce("native", F.lit("")), F.coalesce("scanned", F.lit(""))
    qa, qb, na, nb = T.quality(a), T.quality(b), T.letters(a), T.letters(b)
    replace = (
        F.when(nb == 0, F.lit(False))
        .when(F.coalesce("has_table", F.lit(False)), qb >= F.greatest(F.lit(0.42), qa - 0.08))
        .when(na < 10, (nb >= 10) & (qb >= 0.42))
        .when(T.damaged(a), (nb >= 0.65 * na) & (qb >= F.greatest(F.lit(0.50), qa + 0.08)) & (T.suspicious(b) < T.suspicious(a)))
        .when(qa < 0.48, (nb >= F.greatest(F.lit(10.0), 0.55 * na)) & (qb >= F.greatest(F.lit(0.50), qa + 0.12)))
        .otherwise(F.lit(False))
    )
    return pages.select("doc_id", "page", replace.alias("replace"))


def render_table(rows: Column) -> Column:
    """Markdown of a table of up to 8 columns, 80 rows and 220 characters a cell without line ends; HTML beyond, text beyond 16 columns or 2,000 characters.

    rows: array of arrays of strings; null cells are blank.
    """
    cell = lambda c: F.coalesce(c, F.lit(""))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    longest = F.array_max(F.transform(F.flatten(rows), lambda c: F.length(cell(c))))
    broken = F.exists(F.flatten(rows), lambda c: F.contains(cell(c), F.lit("\n")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(cell(c), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    markdown = F.concat(line(F.get(rows, F.lit(0))), F.lit("\n"), rule, F.when(F.size(rows) > 1, F.concat(F.lit("\n"), F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(1))), line), "\n"))).otherwise(F.lit("")))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), T.escape_html(cell(c)), F.lit("</td>"))), ""), F.lit("</tr>"))), ""), F.lit("</table>"))
    plain = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), "; ")), "\n")
    return F.when((F.size(rows) > 80) | (width > 16) | (longest > 2000), plain).when((width <= 8) & (longest <= 220) & ~broken, markdown).otherwise(html)


def page_sample(pages: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, page of a representative sample: first, last, most text, least text, then pages farthest from those chosen.

    pages: doc_id, page, letters. One document's page numbers and counts are one group.
    """

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(t["page"], t["letters"]))
        chosen = dict.fromkeys([rows[0][0], rows[-1][0], max(rows, key=lambda r: (r[1], -r[0]))[0], min(rows, key=lambda r: (r[1], r[0]))[0]])
        while len(chosen) < min(size, len(rows)):
            rest = [p for p, _ in rows if p not in chosen]
            chosen[max(rest, key=lambda p: (min(abs(p - c) for c in chosen), -p))] = None
        return pd.DataFrame({"doc_id": t["doc_id"].iloc[0], "page": sorted(list(chosen)[:size])})

    return pages.groupBy("doc_id").applyInPandas(pick, "doc_id bigint, page int")

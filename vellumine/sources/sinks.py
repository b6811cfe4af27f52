"""Sinks: content-addressed artifacts, chapter files, EPUB packages, result caches."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import chapters


def put_artifacts(df: DataFrame, payload: str, path: str) -> DataFrame:
    """Appends the payloads that the folder does not have yet, under their digest; gives the rows' digests."""
    digests = df.withColumn("digest", F.sha2(F.col(payload), 256))
    new = digests.select("digest", F.col(payload).alias("payload")).dropDuplicates(["digest"])
    try:
        new = new.join(df.sparkSession.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException:  # the folder is not there yet
        pass
    new.write.mode("append").parquet(path)
    return digests.drop(payload)


def prune_artifacts(spark: SparkSession, path: str, kept: DataFrame, target: str) -> None:
    """Writes the artifacts that are still named to another folder."""
    spark.read.parquet(path).join(kept.select("digest").distinct(), "digest", "left_semi").write.mode("overwrite").parquet(target)


def export_chapters(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Writes one row for each chapter, and gives the keys whose chapters do not add up to their text (none)."""
    parts = chapters(df, key, text)
    parts.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "chapter"))), lambda x: x.chapter), "\n")
    again = back.groupBy(key).agg(F.sha2(whole, 256).alias("h"))
    own = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, F.sha2(F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256).alias("own"))
    return own.join(again, key, "left").where("h is null or h <> own").select(key)


def epub_bytes(title: str, parts: list[tuple[str, str]]) -> bytes:
    """A minimal EPUB of (title, text) chapters; the same input gives the same bytes."""
    out = io.BytesIO()
    stamp = (1980, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, data, kind=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, stamp), data, kind)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(parts)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(parts)))
        put("book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{html.escape(title)}</dc:title></metadata><manifest>{items}<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine>{spine}</spine></package>')
        links = "".join(f'<li><a href="c{i}.xhtml">{html.escape(t)}</a></li>' for i, (t, _) in enumerate(parts))
        put("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol>{links}</ol></nav></body></html>')
        for i, (t, body) in enumerate(parts):
            paragraphs = "".join(f"<p>{html.escape(p)}</p>" for p in body.split("\n\n") if p.strip())
            put(f"c{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(t)}</title></head><body><h1>{html.escape(t)}</h1>{paragraphs}</body></html>')
    return out.getvalue()


def build_epubs(books: DataFrame) -> DataFrame:
    """key, epub of each book. books: key, title, parts (array of struct<title, text>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "epub": [epub_bytes(t or "", [(p["title"] or "", p["text"] or "") for p in ps]) for t, ps in zip(b["title"], b["parts"])]})

    return books.select("key", "title", "parts").mapInPandas(run, "key string, epub binary")


def cached(df: DataFrame, key: str, payload: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and result of each payload: results kept under the payload's digest are used again, the others computed and kept.

    compute takes (digest, payload) rows and gives (digest, result); rows of equal payload are computed once.
    """
    spark = df.sparkSession
    own = df.select(key, F.sha2(F.col(payload), 256).alias("digest"), F.col(payload).alias("payload"))
    need = own.select("digest", "payload").dropDuplicates(["digest"])
    try:
        need = need.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except AnalysisException:
        pass
    compute(need).select("digest", "result").write.mode("append").parquet(path)
    return own.select(key, "digest").join(spark.read.parquet(path).dropDuplicates(["digest"]), "digest", "left").select(key, "result")

"""The pN_ queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import bpe, langid, ocr, packing, pairs, residue, sentences, splitting
from .blocks import wording


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id, text, label of every text with a language label."""
    doc = table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("item_id"), "text", F.col("lang").alias("label"))
    exp = table(spark, d, "markdown_exports").select(F.lit("export").alias("origin"), F.col("export_id").cast("string").alias("item_id"), F.col("primary_markdown").alias("text"), F.col("lang").alias("label"))
    case = table(spark, d, "translation_cases").select(F.lit("translation_case").alias("origin"), F.col("id").alias("item_id"), F.col("source").alias("text"), F.col("source_lang").alias("label"))
    return doc.unionByName(exp).unionByName(case).where("item_id is not null")


def _taught(spark: SparkSession, d: str) -> list[DataFrame]:
    """text, lang of the documents, exports and expected translations, by which languages are learnt."""
    doc = table(spark, d, "documents").select("text", "lang")
    exp = table(spark, d, "markdown_exports").select(F.col("primary_markdown").alias("text"), "lang")
    case = table(spark, d, "translation_cases").select(F.col("expected").alias("text"), F.col("target_lang").alias("lang"))
    return [doc, exp, case]


def language_model(spark: SparkSession, d: str) -> langid.Model:
    """The network, trained on all labelled documents, exports and expected translations."""
    texts = langid.texts_once(_taught(spark, d)).persist(StorageLevel.DISK_ONLY)  # made distinct once, read twice
    model = langid.fit_once(spark, texts)
    texts.unpersist()
    return model


def _language_and_residue_models(spark: SparkSession, d: str) -> tuple[langid.Model, residue.Models]:
    """language_model, and the models of residue fitted on all documents; wordings are told apart once for both."""
    documents = table(spark, d, "documents").select("text", langid.code_column(F.col("lang")).alias("code"), residue.is_prose().alias("prose"))
    others = langid.labelled(_taught(spark, d)[1:]).withColumn("prose", F.lit(False))
    taught = F.col("code").isNotNull() & (F.trim("text") != "")
    rows = documents.where(taught | F.col("prose")).unionByName(others).withColumn("h", F.xxhash64(wording(F.col("text"))))
    rows = rows.repartition("h").persist(StorageLevel.DISK_ONLY)
    rows.count()  # from here on it is known that they are apart by h, so that no other shuffle follows
    models = langid.fit_once(spark, langid.once(rows.where(taught))), residue.fit_on(residue.once(rows.where("prose")))
    rows.unpersist()
    return models


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every text (block -1) and of every block of running text."""
    return langid.segments(_labelled(spark, d), language_model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id, block_no, lang of missing or wrong labels and of blocks in another language.

    Residue is only looked for in documents that have a case; those with residue are left out.
    """
    languages, residues = _language_and_residue_models(spark, d)
    cases = langid.wrong_labels(_labelled(spark, d), languages, keep_text=True)
    shared = spark.sparkContext.broadcast(residues)

    def without_residue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].where(b["text"].notna(), None).tolist()
            distinct = sorted({t for t in texts if t})
            bad = {t for t, kinds in zip(distinct, residue.kinds_of(shared.value, distinct)) if kinds}
            yield b.loc[[t not in bad for t in texts], ["origin", "item_id", "block_no", "lang"]]

    found = cases.mapInPandas(without_residue, "origin string, item_id string, block_no int, lang string")
    return found.distinct()


def _running(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id, text of the exports that were not scanned and of the expected translations."""
    exp = table(spark, d, "markdown_exports").where("ocr_pages = 0").select(F.lit("export").alias("origin"), F.col("export_id").cast("string").alias("item_id"), F.col("primary_markdown").alias("text"))
    case = table(spark, d, "translation_cases").select(F.lit("translation_case").alias("origin"), F.col("id").alias("item_id"), F.col("expected").alias("text"))
    return exp.unionByName(case).where("item_id is not null and text is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id, start_pos, end_pos of every sentence."""
    items = _running(spark, d)
    return sentences.split(items, sentences.learn(items), keep_text=False).distinct()


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its text; sentences of repeated rows count once."""
    items = _running(spark, d)
    return sentences.split(items, sentences.learn(items)).dropDuplicates(["origin", "item_id", "start_pos", "end_pos"])


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return ocr.scanned(table(spark, d, "markdown_exports"), table(spark, d, "pdf_review_issues"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id, line_no, defect of every noisy line of the scanned texts."""
    return ocr.defects(_scanned(spark, d))[0]


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts repaired into continuous paragraphs."""
    return ocr.paragraphs(_scanned(spark, d).dropDuplicates(["origin", "item_id"]))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.sized_items(table(spark, d, "markdown_exports"), table(spark, d, "markdown_chapters"), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """origin, item_id of the items longer than their limit."""
    return splitting.oversized(_items(spark, d))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The numbered pieces of every item; an item within its limit is one piece."""
    return splitting.split_items(_items(spark, d)).dropDuplicates(["origin", "item_id", "piece_no"])


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """That the pieces of every item are within their limit, cover it and hold its text."""
    return splitting.check(_items(spark, d), p5_pieces(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """name, response_no, defect of every defective answer."""
    return pairs.defects(table(spark, d, "response_cases"), language_model(spark, d)).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and ids of every document."""
    return bpe.encode_column(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece, container, tokens of every document with at least one token."""
    return packing.pack(bpe.count_column(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and what share of their room is used."""
    c = p8_containers(spark, d).groupBy("container").agg(F.sum("tokens").alias("used"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(F.avg("used") / packing.CAPACITY, 6).alias("share"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """That no document is lost, repeated or split needlessly and no container is overfull."""
    sizes = cut(bpe.count_column(table(spark, d, "documents")))
    return packing.check(sizes, packing.pack(sizes))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, kind of the residue in every document."""
    documents = table(spark, d, "documents")
    return residue.residue(documents, residue.fit(documents))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of the documents with text and without residue."""
    documents = table(spark, d, "documents")
    return residue.clean(documents.where("trim(text) <> ''"), p9_found(spark, d)).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p4_found": p4_found,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_check": p5_check,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
}

"""Queries of evidence inside and between texts, with SQL that another engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..functions import text as T
from ..operators import evidence as E
from ..session import table
from .corpus import _BLOCKS, EXPORTS, _exports
from .versions import FLAT_WORDS, NUMBERS


def written_numbers(s: SparkSession, d: str) -> DataFrame:
    documents = table(s, d, "documents").select("doc_id", "text", T.language_code(F.col("lang")).alias("code")).distinct()
    return E.written_numbers(documents, "doc_id", "text", "code")


def contents_entries(s: SparkSession, d: str) -> DataFrame:
    return E.contents_entries(_exports(s, d), "export_id", "primary_markdown")


def contents_match(s: SparkSession, d: str) -> DataFrame:
    titles = table(s, d, "markdown_chapters").select("export_id", "chapter_no", "title").distinct()
    return E.match_titles(contents_entries(s, d), titles, "export_id", "chapter_no")


def untranslated_sentences(s: SparkSession, d: str) -> DataFrame:
    return E.untranslated(table(s, d, "translation_cases").select("id", "source", "expected").distinct(), "id", "source", "expected")


def token_consensus(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "pdf_review_issues").select("identifier", "export_id", "markdown").distinct()
    return E.token_consensus(parts, _exports(s, d), "identifier", "export_id", "markdown", "primary_markdown")


def emphasis_spans(s: SparkSession, d: str) -> DataFrame:
    return E.emphasis(_exports(s, d), "export_id", "primary_markdown")


def merged_glossary(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "translation_cases").where("glossary is not null and target_lang is not null").select("target_lang", "id", F.explode("glossary").alias("g"))
    return E.merge_glossaries(c.select("target_lang", F.col("id").alias("priority"), F.col("g.source").alias("term"), F.col("g.target").alias("wanted")), "target_lang")


def event_violations(s: SparkSession, d: str) -> DataFrame:
    return E.violations(
        table(s, d, "job_events"),
        {"payload_present": F.col("payload").isNotNull(), "attempt_named": F.trim("payload.attempt_id") != "", "job_named": F.trim("job_id") != "", "sequence_positive": F.col("sequence") >= 0, "state_changes": F.col("payload.from_status") != F.col("payload.to_status")},
    )


#: Headings of contents lists, written out here on their own.
_TITLES = ", ".join(D.q(t) for t in "contents|table of contents|contenido|índice|contenidos|sommaire|table des matières|inhalt|inhaltsverzeichnis|conteúdo|sumário|sommario|indice|содержание|оглавление|目录|目次|المحتويات|สารบัญ|विषय-सूची".split("|"))
_ENTRIES = (
    _BLOCKS
    + f""",
    led AS (SELECT export_id, position, block, trim(regexp_replace(lower(lag(block) OVER (PARTITION BY export_id ORDER BY position)), '^[ \\t]{{0,3}}#{{1,6}}[ \\t]+', '')) AS title FROM blocks),
    lists AS (SELECT export_id, position, regexp_extract_all(block, '\\[([^\\]\\n]+)\\]\\(', 1) AS labels FROM led
              WHERE title IN ({_TITLES}) AND regexp_matches(block, '^[ \\t]{{0,3}}(?:[-*+]|[0-9]{{1,9}}[.)])[ \\t]')),
    items AS (SELECT export_id, position, unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM lists),
    entries AS (SELECT export_id, row_number() OVER (PARTITION BY export_id ORDER BY position, i) - 1 AS entry_no, label FROM items)"""
)
_FLAT = "trim(regexp_replace(lower({}), '[ \\t]+', ' ', 'g'))"

SQL: dict[str, str] = {
    "written_numbers": f"""
        WITH {NUMBERS}, said AS (SELECT doc_id, lang, unnest(regexp_extract_all({FLAT_WORDS.format('text')}, pattern, 1)) AS w
            FROM (SELECT DISTINCT doc_id, text, {D.language_code('lang')} AS code FROM documents WHERE text IS NOT NULL) JOIN runs ON runs.lang = code)
        SELECT doc_id, v::INT AS value, count(*) AS n FROM said JOIN words ON words.lang = said.lang AND words.w = replace(said.w, '  ', ' ') GROUP BY ALL""",
    "contents_entries": f"WITH {_ENTRIES} SELECT export_id, entry_no, label FROM entries",
    "contents_match": f"""
        WITH {_ENTRIES}, t AS (SELECT export_id, {_FLAT.format('title')} AS flat, min(chapter_no) AS chapter_no FROM (SELECT DISTINCT export_id, chapter_no, title FROM markdown_chapters WHERE title IS NOT NULL) GROUP BY ALL HAVING count(*) = 1)
        SELECT e.export_id, entry_no, label, chapter_no FROM entries e LEFT JOIN t ON t.export_id = e.export_id AND t.flat = {_FLAT.format('label')}""",
    "untranslated_sentences": f"""
        SELECT DISTINCT id, sentence FROM (SELECT id, expected, trim(unnest(regexp_extract_all({D.unix('source')}, '[^.!?…\\n]+[.!?…]'))) AS sentence FROM translation_cases WHERE source IS NOT NULL AND expected IS NOT NULL)
        WHERE {D.letters('sentence')} >= 24 AND contains(expected, sentence)""",
    "token_consensus": f"""
        WITH w AS (SELECT export_id, t AS good, count(*) AS n FROM (SELECT export_id, unnest(regexp_extract_all(lower(primary_markdown), '\\p{{L}}{{5,}}')) AS t FROM {EXPORTS}) GROUP BY ALL),
        p AS (SELECT DISTINCT identifier, export_id, unnest(regexp_extract_all(lower(markdown), '\\p{{L}}{{5,}}')) AS token FROM pdf_review_issues WHERE markdown IS NOT NULL),
        q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.export_id = p.export_id AND w.good = p.token)),
        near AS (SELECT identifier, token, good FROM q JOIN w ON q.export_id = w.export_id WHERE abs(length(token) - length(good)) <= 1 AND n >= 3 AND {D.one_edit('token', 'good')})
        SELECT identifier, token, min(good) AS "right" FROM near GROUP BY ALL HAVING count(DISTINCT good) = 1""",
    "emphasis_spans": f"""
        SELECT export_id, {D.count_of('t', r'\*\*[^*\n]+\*\*')} AS strong, {D.count_of(f"regexp_replace(t, {D.q(r'\*\*[^*\n]+\*\*')}, ' ', 'g')", r'\*[^* \t\n][^*\n]*\*')} AS light, {D.count_of('t', r'`[^`\n]+`')} AS code
        FROM (SELECT export_id, {D.unix('primary_markdown')} AS t FROM {EXPORTS})""",
    "merged_glossary": """
        SELECT target_lang, term, wanted FROM (
            SELECT target_lang, lower(trim(term)) AS low, first(term ORDER BY id, term, wanted) AS term, first(wanted ORDER BY id, term, wanted) AS wanted, min(id) AS priority FROM (
                SELECT target_lang, id, g.source AS term, g.target AS wanted FROM (SELECT target_lang, id, unnest(glossary) AS g FROM translation_cases WHERE target_lang IS NOT NULL)) WHERE trim(term) <> '' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY target_lang ORDER BY priority, low) <= 50""",
    "event_violations": """
        SELECT rule, n FROM (SELECT count(*) FILTER (payload IS NULL) AS payload_present, count(*) FILTER (coalesce(trim(payload.attempt_id) = '', true)) AS attempt_named,
            count(*) FILTER (coalesce(trim(job_id) = '', true)) AS job_named, count(*) FILTER (coalesce(sequence < 0, true)) AS sequence_positive, count(*) FILTER (coalesce(payload.from_status = payload.to_status, true)) AS state_changes FROM job_events)
        UNPIVOT (n FOR rule IN (payload_present, attempt_named, job_named, sequence_positive, state_changes))""",
}

QUERIES = {f.__name__: f for f in (written_numbers, contents_entries, contents_match, untranslated_sentences, token_consensus, emphasis_spans, merged_glossary, event_violations)}

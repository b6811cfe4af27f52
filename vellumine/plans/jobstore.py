"""Queries over the job store's nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..session import shared_folder, table


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return nested.tagged_tables(table(spark, d, "jobs"), table(spark, d, "reviews"), table(spark, d, "job_events"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """relation, parent_id, child_key of every distinct child of the latest readable records."""
    return _tagged(spark, d).where(F.col("tag").isin(*nested.CHILDREN)).select(F.col("tag").alias("relation"), "parent_id", "child_key").distinct()


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The tagged rows, walked once and written by tag; every flat table reads its own folder of them."""
    inputs = [table(spark, d, t) for t in ("jobs", "reviews", "job_events")]
    return nested.written_once(lambda: _tagged(spark, d), inputs, shared_folder(spark))


def _flat(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.read_tag(_stored(spark, d), tag, nested.SCHEMAS[tag])

    query.__doc__ = f"The flat table of every {tag}, typed."
    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    **{f"p1_table_{tag}": _flat(tag) for tag in nested.SCHEMAS},
}
def _open(j: str) -> str:
    """One step towards the record: out of a string, a one-item list or a wrapping key."""
    return f"""CASE json_type({j}) WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({j}, '$')) THEN CAST(json_extract_string({j}, '$') AS JSON) END
        WHEN 'ARRAY' THEN CASE WHEN json_array_length({j}) = 1 THEN json_extract({j}, '$[0]') END
        WHEN 'OBJECT' THEN CASE WHEN len(json_keys({j})) = 1 THEN coalesce(json_extract({j}, '$.job'), json_extract({j}, '$.review'), {j}) ELSE {j} END END"""


def _member(key: str) -> str:
    return f"json_extract(c, '$.\"' || {key} || '\"')"


def _entries(relation: str, source: str, collection: str, key: str) -> str:
    """Children of a collection that is a list of objects or pairs, one pair, one object, or a map."""
    return f"""
        SELECT '{relation}' AS relation, id AS parent_id, CASE json_type(x) WHEN 'ARRAY' THEN json_extract_string(x, '$[0]') ELSE json_extract_string(x, '$.{key}') END AS child_key, x AS node
        FROM (SELECT id, unnest(CAST(json_extract(c, '$[*]') AS JSON[])) AS x FROM (SELECT id, {collection} AS c FROM {source}) WHERE json_type(c) = 'ARRAY' AND json_type(json_extract(c, '$[0]')) <> 'VARCHAR')
        UNION ALL SELECT '{relation}', id, json_extract_string(c, '$[0]'), NULL FROM (SELECT id, {collection} AS c FROM {source}) WHERE json_type(c) = 'ARRAY' AND json_type(json_extract(c, '$[0]')) = 'VARCHAR'
        UNION ALL SELECT '{relation}', id, json_extract_string(c, '$.{key}'), c FROM (SELECT id, {collection} AS c FROM {source}) WHERE json_type(c) = 'OBJECT' AND json_extract(c, '$.{key}') IS NOT NULL
        UNION ALL SELECT '{relation}', id, k, {_member('k')} FROM (SELECT id, c, unnest(json_keys(c)) AS k FROM (SELECT id, {collection} AS c FROM {source}) WHERE json_type(c) = 'OBJECT' AND json_extract(c, '$.{key}') IS NULL)"""


_LATEST = f"""
    raw AS (
        SELECT 'job' AS t, id, updated_at, trim(replace(payload, chr(65279), ''), ' ' || chr(9) || chr(10) || chr(13)) AS p FROM jobs
        UNION ALL SELECT 'review', id, updated_at, trim(replace(payload, chr(65279), ''), ' ' || chr(9) || chr(10) || chr(13)) FROM reviews
    ),
    l0 AS (SELECT *, CASE WHEN p <> '' AND json_valid(p) THEN CAST(p AS JSON) END AS j FROM raw),
    l1 AS (SELECT t, id, updated_at, p, {_open('j')} AS j FROM l0), l2 AS (SELECT t, id, updated_at, p, {_open('j')} AS j FROM l1),
    l3 AS (SELECT t, id, updated_at, p, {_open('j')} AS j FROM l2), l4 AS (SELECT t, id, updated_at, p, {_open('j')} AS j FROM l3),
    latest AS (SELECT t, id, first(j ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC, p DESC) AS j FROM l4 WHERE id IS NOT NULL AND json_type(j) = 'OBJECT' GROUP BY t, id),
    jobs_ AS (SELECT id, j FROM latest WHERE t = 'job'), reviews_ AS (SELECT id, j FROM latest WHERE t = 'review')"""
_FOUND = f"""
    WITH {_LATEST},
    stages_ AS ({_entries('stage', 'jobs_', "json_extract(j, '$.stages')", 'kind')}),
    files AS (SELECT parent_id || '/' || child_key AS parent_id, coalesce(json_extract(node, '$.artifact_ids'), json_extract(node, '$.artifactIds')) AS a FROM stages_),
    parts AS (SELECT id, json_extract(j, '$.configuration.ai.components') AS c FROM jobs_)
    SELECT DISTINCT relation, parent_id, child_key FROM (
        SELECT relation, parent_id, child_key FROM stages_
        UNION ALL SELECT 'artifact', parent_id, unnest(json_extract_string(a, '$[*]')) FROM files WHERE json_type(a) = 'ARRAY'
        UNION ALL SELECT 'artifact', parent_id, json_extract_string(a, '$') FROM files WHERE json_type(a) = 'VARCHAR'
        UNION ALL SELECT relation, parent_id, child_key FROM ({_entries('glossary', 'jobs_', "json_extract(j, '$.configuration.translation.glossary')", 'source')})
        UNION ALL SELECT relation, parent_id, child_key FROM ({_entries('signal', 'jobs_', "coalesce(json_extract(j, '$.review_recommendation.signal_counts'), json_extract(j, '$.reviewRecommendation.signalCounts'))", 'signal')})
        UNION ALL SELECT relation, parent_id, child_key FROM ({_entries('unit', 'reviews_', "json_extract(j, '$.units')", 'id')})
        UNION ALL SELECT 'component', id, 'translation' FROM parts WHERE json_type(json_extract(c, '$.translation')) <> 'NULL'
        UNION ALL SELECT 'component', id, 'review' FROM parts WHERE json_type(json_extract(c, '$.review')) <> 'NULL'
        UNION ALL SELECT 'component', id, 'visual_ocr' FROM parts WHERE coalesce(json_type(json_extract(c, '$.visual_ocr')), 'NULL') <> 'NULL' OR coalesce(json_type(json_extract(c, '$.visualOcr')), 'NULL') <> 'NULL' OR coalesce(json_type(json_extract(c, '$.visual')), 'NULL') <> 'NULL'
        UNION ALL SELECT 'attempt', job_id, payload.attempt_id FROM job_events WHERE job_id IS NOT NULL AND trim(payload.attempt_id) <> ''
    ) WHERE child_key IS NOT NULL"""

def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _field(node: str, path: str, kind: str) -> str:
    """A scalar at a path of field names, each in snake or camel case; objects and lists are none."""
    options = [""]
    for step in path.split("."):
        options = [f"{o}.{x}" for o in options for x in dict.fromkeys((step, _camel(step)))]
    raw = "coalesce(" + ", ".join(f"CASE WHEN json_type({node}, '${o}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({node}, '${o}') END" for o in options) + ")"
    return f"TRY_CAST({raw} AS {kind})" if kind != "VARCHAR" else raw


def _typed(node: str, fields: str) -> str:
    """fields: name:kind, or name=path:kind."""
    out = []
    for f in fields.split():
        name, kind = f.rsplit(":", 1)
        name, _, path = name.partition("=")
        out.append(f"{_field(node, path or name, {'s': 'VARCHAR', 'i': 'INTEGER', 'l': 'BIGINT', 'b': 'BOOLEAN'}[kind])} AS {name}")
    return ", ".join(out)


_STAGE_FIELDS = "kind:s availability:s status:s progress_current:i progress_total:i progress_message:s attempt:i review_id:s error_code:s error_message:s started_at:s finished_at:s"
_UNIT_FIELDS = "original_artifact_id:s proposed_artifact_id:s edited_artifact_id:s choice:s required:b label:s original_selectable:b target:s recommended_choice:s warning:s severity:s proposed_selectable:b"
_JOB_FIELDS = (
    "payload_version:i order:l source_path=source.path:s source_format=source.format:s source_size_bytes=source.size_bytes:l source_modified_ns=source.modified_ns:l source_content_sha256=source.content_sha256:s configuration_revision:i "
    "configuration_output_configured=configuration.output.configured:b configuration_output_format=configuration.output.format:s configuration_output_directory=configuration.output.directory:s "
    "configuration_output_title=configuration.output.title:s configuration_output_author=configuration.output.author:s configuration_output_include_images=configuration.output.include_images:b "
    "configuration_output_preserve_styles=configuration.output.preserve_styles:b configuration_output_markdown_organization=configuration.output.markdown_organization:s configuration_output_cover_strategy=configuration.output.cover_strategy:s "
    "configuration_ai_model=configuration.ai.model:s configuration_ai_context_window=configuration.ai.context_window:i configuration_translation_enabled=configuration.translation.enabled:b "
    "configuration_translation_method=configuration.translation.method:s configuration_translation_target_language=configuration.translation.target_language:s configuration_plan=configuration.plan:s "
    "configuration_page_range_first_page=configuration.page_range.first_page:i configuration_page_range_last_page=configuration.page_range.last_page:i configuration_force_pdf_ocr=configuration.force_pdf_ocr:b "
    "review_recommendation_scope_fingerprint=review_recommendation.scope_fingerprint:s result_path:s"
)
_GLOSSARY = _entries("glossary", "jobs_", "json_extract(j, '$.configuration.translation.glossary')", "source")
_SIGNALS = _entries("signal", "jobs_", "coalesce(json_extract(j, '$.review_recommendation.signal_counts'), json_extract(j, '$.reviewRecommendation.signalCounts'))", "signal")
_PART = "json_extract(c, '$.{}')"
_PARTS = " UNION ALL ".join(
    f"SELECT id, '{name}' AS child_key, {node} AS node FROM parts WHERE coalesce(json_type({node}), 'NULL') <> 'NULL'"
    for name, node in (
        ("translation", _PART.format("translation")), ("review", _PART.format("review")),
        ("visual_ocr", f"coalesce(CASE WHEN json_type({_PART.format('visual_ocr')}) <> 'NULL' THEN {_PART.format('visual_ocr')} END, CASE WHEN json_type({_PART.format('visualOcr')}) <> 'NULL' THEN {_PART.format('visualOcr')} END, {_PART.format('visual')})"),
    )
)


def _value(key: str, kind: str) -> str:
    """The value of an entry: of a pair, of an object under its name, or of a map as it stands."""
    text = f"CASE json_type(node) WHEN 'ARRAY' THEN json_extract_string(node, '$[1]') WHEN 'OBJECT' THEN json_extract_string(node, '$.{key}') ELSE json_extract_string(node, '$') END"
    return f"TRY_CAST({text} AS {kind})" if kind != "VARCHAR" else text


SQL: dict[str, str] = {
    "p1_found": _FOUND,
    "p1_table_job": f"WITH {_LATEST} SELECT NULL::VARCHAR AS parent_id, id AS child_key, {_typed('j', _JOB_FIELDS)} FROM jobs_",
    "p1_table_review": f"WITH {_LATEST} SELECT {_field('j', 'job_id', 'VARCHAR')} AS parent_id, id AS child_key, {_typed('j', 'payload_version:i stage:s kind:s status:s input_artifact_id:s input_version:i created_at:s updated_at:s')} FROM reviews_",
    "p1_table_stage": f"WITH {_LATEST}, x AS ({_entries('stage', 'jobs_', "json_extract(j, '$.stages')", 'kind')}) SELECT DISTINCT parent_id, child_key, {_typed('node', _STAGE_FIELDS)} FROM x WHERE child_key IS NOT NULL",
    "p1_table_artifact": f"""
        WITH {_LATEST}, stages_ AS ({_entries('stage', 'jobs_', "json_extract(j, '$.stages')", 'kind')}),
        files AS (SELECT parent_id || '/' || child_key AS parent_id, coalesce(json_extract(node, '$.artifact_ids'), json_extract(node, '$.artifactIds')) AS a FROM stages_)
        SELECT DISTINCT parent_id, child_key, child_key AS value FROM (
            SELECT parent_id, unnest(json_extract_string(a, '$[*]')) AS child_key FROM files WHERE json_type(a) = 'ARRAY' UNION ALL SELECT parent_id, json_extract_string(a, '$') FROM files WHERE json_type(a) = 'VARCHAR')""",
    "p1_table_glossary": f"WITH {_LATEST}, x AS ({_GLOSSARY}) SELECT DISTINCT parent_id, child_key, {_value('target', 'VARCHAR')} AS value FROM x WHERE child_key IS NOT NULL",
    "p1_table_signal": f"WITH {_LATEST}, x AS ({_SIGNALS}) SELECT DISTINCT parent_id, child_key, {_value('count', 'BIGINT')} AS value FROM x WHERE child_key IS NOT NULL",
    "p1_table_component": f"""
        WITH {_LATEST}, parts AS (SELECT id, json_extract(j, '$.configuration.ai.components') AS c FROM jobs_)
        SELECT DISTINCT id AS parent_id, child_key, {_typed('node', 'policy_version:s model:s digest:s context_window:i')} FROM ({_PARTS})""",
    "p1_table_unit": f"WITH {_LATEST}, x AS ({_entries('unit', 'reviews_', "json_extract(j, '$.units')", 'id')}) SELECT DISTINCT parent_id, child_key, {_typed('node', _UNIT_FIELDS)} FROM x WHERE child_key IS NOT NULL",
    "p1_table_attempt": """
        SELECT job_id AS parent_id, p.attempt_id AS child_key, p.attempt_id AS attempt_id, p.payload_version AS payload_version, p.stage AS stage, p.to_status AS to_status,
            p.configuration_revision AS configuration_revision, p.error_code AS error_code
        FROM (SELECT job_id, max_by(payload, sequence) AS p FROM job_events WHERE job_id IS NOT NULL AND trim(payload.attempt_id) <> '' GROUP BY job_id, payload.attempt_id)""",
}

"""Nested records to flat, linked tables by single-pass tagged emission.

A depth-first visitor walks each record once and emits, for every child it meets, a row of table tag, parent key,
own key and payload (the child's own scalar fields as JSON). One stream of tagged rows then serves every flat table:
it is written partitioned by tag, and a schema is applied on reading a tag.

Defined results of unusual input: a null, blank, JSON-null, scalar, truncated or multi-record payload is unreadable
and gives nothing; a record may stand alone, in a one-item list, under one wrapping key, behind a byte-order mark or
as a JSON string holding the record; field names count without regard to snake or camel case; a collection may be a
list, one bare item, or a map from key to item; children without a key give nothing; repeated keys are emitted once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMITTED = "tag string, parent_id string, child_key string, payload string"
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def snake(name: str) -> str:
    return _CAMEL.sub("_", name).lower().replace("-", "_")


def record_of(payload: str | None, wrappers: tuple[str, ...], marks: tuple[str, ...]) -> dict | None:
    """The one record that a payload holds, or None. marks: a record has at least one of these fields."""
    value: object = payload
    for _ in range(4):
        if isinstance(value, str):
            text = value.lstrip("﻿").strip()
            if not text:
                return None
            try:
                value = json.loads(text)
            except (ValueError, RecursionError):
                return None
        elif isinstance(value, list):
            if len(value) != 1:
                return None
            value = value[0]
        elif isinstance(value, dict):
            names = {snake(k): k for k in value}
            if not names.keys() & set(marks) and len(names) == 1 and (inner := next((names[w] for w in wrappers if w in names), None)):
                value = value[inner]
            else:
                return value
        else:
            return None
    return value if isinstance(value, dict) else None


def _fields(node: dict) -> dict:
    return {snake(k): v for k, v in node.items()}


def _flat(node: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """The scalar fields of a record and of the objects inside it, under joined names; lists are other tables' rows."""
    for k, v in _fields(node).items():
        if isinstance(v, dict):
            yield from _flat(v, f"{prefix}{k}_")
        elif not isinstance(v, list):
            yield f"{prefix}{k}", v


def _scalars(node: object) -> str | None:
    if not isinstance(node, dict):
        return None if node is None else json.dumps({"value": node}, ensure_ascii=False)
    return json.dumps({k: v for k, v in _fields(node).items() if not isinstance(v, dict | list)}, ensure_ascii=False)


@dataclass(frozen=True)
class Child:
    """One flat table: where its rows hang in a record and how they are keyed.

    path: field names from the record down to the collection. key: name of the key field; None where the collection's
    own keys or plain values are the keys. pairs: the collection is a list of (key, value) pairs or a map; value: the name
    of the value in a pair that is written as an object.
    alias: older spellings of keys. skip_null: a null child is absent. nested: tables below each row; their parent key
    is `parent/key`.
    """

    tag: str
    path: tuple[str, ...]
    key: str | None = None
    pairs: bool = False
    value: str | None = None
    skip_null: bool = False
    alias: dict[str, str] = field(default_factory=dict)
    nested: tuple["Child", ...] = ()


def _items(found: object, child: Child) -> Iterator[tuple[object, object]]:
    """(key, node) of each item of a collection in any of its shapes."""
    if found is None:
        return
    if child.pairs:
        if isinstance(found, dict):
            f = _fields(found)
            if "source" in f and "target" in f and len(f) <= 3 and child.key:
                yield f.get(child.key), found
            else:
                yield from found.items()
        elif isinstance(found, list):
            if len(found) == 2 and isinstance(found[0], str) and not isinstance(found[1], list | dict):
                yield found[0], found[1]
            else:
                for x in found:
                    if isinstance(x, list) and x:
                        yield x[0], x[1] if len(x) > 1 else None
                    elif isinstance(x, dict):
                        f = _fields(x)
                        names = [child.key, "name", "source", "term", "key", "kind"]
                        if (k := next((n for n in names if n and n in f), None)) is not None:
                            yield f[k], x
                        else:
                            yield from x.items()
                    elif isinstance(x, str):
                        yield x, None
        elif isinstance(found, str):
            yield found, None
    elif child.key is None and child.path and not isinstance(found, dict):
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                yield _fields(x).get("id"), x
            else:
                yield x, x
    elif isinstance(found, dict):
        f = _fields(found)
        if child.key and child.key in f and not isinstance(f[child.key], dict | list):
            yield f[child.key], found
        else:
            for k, v in found.items():
                own = _fields(v).get(child.key) if isinstance(v, dict) and child.key else None
                yield own if own is not None else k, v
    elif isinstance(found, list):
        for x in found:
            if isinstance(x, dict):
                yield _fields(x).get(child.key), x
            elif isinstance(x, str):
                yield x, None


def visit(node: dict, parent: str, children: tuple[Child, ...]) -> Iterator[tuple[str, str, str, str | None]]:
    """Depth first: each child before its later siblings, its own children right after it."""
    for child in children:
        found: object = node
        for step in child.path:
            if isinstance(found, list) and len(found) == 1:
                found = found[0]
            found = _fields(found).get(step) if isinstance(found, dict) else None
        for key, item in _items(found, child):
            if key is None or isinstance(key, dict | list) or (child.skip_null and item is None):
                continue
            name = str(key)
            name = child.alias.get(snake(name), child.alias.get(name, name))
            if child.value and isinstance(item, dict):
                item = _fields(item).get(child.value)
            yield child.tag, parent, name, _scalars(item)
            if child.nested and isinstance(item, dict):
                yield from visit(item, f"{parent}/{name}", child.nested)


def instant(text: Column) -> Column:
    """ISO text of several notations and zones as an instant; unreadable text is null."""
    clean = F.regexp_replace(F.trim(text), r"(?i)\s*(?:utc|gmt)$", "Z")
    clean = F.regexp_replace(clean, r",(\d+)", ".$1")
    return F.coalesce(F.try_to_timestamp(clean), F.try_to_timestamp(F.regexp_replace(clean, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def readable(payload: Column, wrappers: tuple[str, ...], marks: tuple[str, ...]) -> Column:
    @F.pandas_udf(T.BooleanType())
    def check(s: pd.Series) -> pd.Series:
        return s.map(lambda p: record_of(p, wrappers, marks) is not None)

    return check(payload)


def latest_readable(df: DataFrame, wrappers: tuple[str, ...], marks: tuple[str, ...]) -> DataFrame:
    """id and payload of the readable version latest in time; on equal instants the greatest payload text.

    The maximum is combined before the shuffle, so an id that holds a third of all rows costs one row per task.
    Columns other than id, payload and updated_at are not read.
    """
    kept = df.select("id", "payload", instant(F.col("updated_at")).alias("_at")).where(F.col("id").isNotNull() & F.col("payload").isNotNull())
    kept = kept.where(readable(F.col("payload"), wrappers, marks))
    newest = F.max(F.struct(F.coalesce("_at", F.timestamp_micros(F.lit(-62135596800000000))).alias("_at"), F.col("payload"))).alias("v")
    return kept.groupBy("id").agg(newest).select("id", F.col("v.payload").alias("payload"))


def emit(df: DataFrame, children: tuple[Child, ...], wrappers: tuple[str, ...] = (), marks: tuple[str, ...] = (), root: tuple[str, str | None] | None = None) -> DataFrame:
    """The tagged rows of each (id, payload) row; see the module's text for shapes and odd cases.

    root: the tag of the record's own row, whose payload are its scalar fields at any depth, and the field that names
    its parent, if it has one.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for ident, payload in zip(b["id"], b["payload"], strict=True):
                if ident is None or (record := record_of(payload, wrappers, marks)) is None:
                    continue
                seen = set()
                if root is not None:
                    own = dict(_flat(record))
                    parent = own.get(root[1]) if root[1] else None
                    rows.append((root[0], None if parent is None else str(parent), ident, json.dumps(own, ensure_ascii=False)))
                for row in visit(record, ident, children):
                    if row[:3] not in seen:
                        seen.add(row[:3])
                        rows.append(row)
            yield pd.DataFrame(rows, columns=["tag", "parent_id", "child_key", "payload"], dtype=object)

    return df.select("id", "payload").mapInPandas(walk, EMITTED)


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Writes a stream of tagged rows as one folder for each tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_tag(tagged: DataFrame, tag: str, schema: str) -> DataFrame:
    """One flat table of a tagged stream or of a folder written by write_tagged: its keys and the typed payload fields."""
    rows = tagged.where(F.col("tag") == tag)
    return rows.select("parent_id", "child_key", F.from_json("payload", schema).alias("p")).select("parent_id", "child_key", "p.*")


def written_once(tagged: Callable[[], DataFrame], inputs: list[DataFrame], folder: str) -> DataFrame:
    """The tagged rows from a folder below the given one, written on the first call for these input files.

    The folder's name is a digest of the files' names, sizes and times, so changed files are read anew.
    """
    spark = inputs[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    facts = []
    for name in sorted(f for df in inputs for f in df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        facts.append((name, status.getLen(), status.getModificationTime()))
    target = f"{folder}/tagged-{hashlib.sha256(repr((SCHEMAS, facts)).encode()).hexdigest()[:24]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        write_tagged(tagged(), target)
    return spark.read.schema(EMITTED).parquet(target)


ARTIFACTS = Child("artifact", ("artifact_ids",))
JOB = (
    Child("stage", ("stages",), key="kind", nested=(ARTIFACTS,)),
    Child("glossary", ("configuration", "translation", "glossary"), key="source", pairs=True, value="target"),
    Child("signal", ("review_recommendation", "signal_counts"), key="signal", pairs=True, value="count"),
    Child("component", ("configuration", "ai", "components"), key="component", pairs=True, skip_null=True, alias={"visual": "visual_ocr", "visual_ocr": "visual_ocr"}),
)
REVIEW = (Child("unit", ("units",), key="id"),)
CHILDREN = ("stage", "artifact", "glossary", "signal", "component", "unit", "attempt")
JOB_MARKS = ("payload_version", "id", "stages", "configuration", "source")
REVIEW_MARKS = ("payload_version", "id", "units", "job_id", "stage")

#: Typed fields of each flat table.
SCHEMAS = {
    "job": "payload_version int, order bigint, source_path string, source_format string, source_size_bytes bigint, source_modified_ns bigint, source_content_sha256 string, configuration_revision int, "
    "configuration_output_configured boolean, configuration_output_format string, configuration_output_directory string, configuration_output_title string, configuration_output_author string, "
    "configuration_output_include_images boolean, configuration_output_preserve_styles boolean, configuration_output_markdown_organization string, configuration_output_cover_strategy string, "
    "configuration_ai_model string, configuration_ai_context_window int, configuration_translation_enabled boolean, configuration_translation_method string, configuration_translation_target_language string, "
    "configuration_plan string, configuration_page_range_first_page int, configuration_page_range_last_page int, configuration_force_pdf_ocr boolean, review_recommendation_scope_fingerprint string, result_path string",
    "review": "payload_version int, stage string, kind string, status string, input_artifact_id string, input_version int, created_at string, updated_at string",
    "stage": "kind string, availability string, status string, progress_current int, progress_total int, progress_message string, attempt int, review_id string, error_code string, error_message string, started_at string, finished_at string",
    "artifact": "value string",
    "glossary": "value string",
    "signal": "value bigint",
    "component": "policy_version string, model string, digest string, context_window int",
    "unit": "original_artifact_id string, proposed_artifact_id string, edited_artifact_id string, choice string, required boolean, label string, original_selectable boolean, target string, recommended_choice string, warning string, severity string, proposed_selectable boolean",
    "attempt": "attempt_id string, payload_version int, stage string, to_status string, configuration_revision int, error_code string",
}


def job_tables(jobs: DataFrame) -> DataFrame:
    return emit(latest_readable(jobs, ("job",), JOB_MARKS), JOB, ("job",), JOB_MARKS, ("job", None))


def review_tables(reviews: DataFrame) -> DataFrame:
    return emit(latest_readable(reviews, ("review",), REVIEW_MARKS), REVIEW, ("review",), REVIEW_MARKS, ("review", "job_id"))


def attempts(events: DataFrame) -> DataFrame:
    """parent_id, child_key and the fields of each (job, attempt): those of its event with the highest sequence.

    Events are combined per attempt before the shuffle, so the hot job costs no more than any other. All of it is a
    projection of the struct; no record is taken apart.
    """
    attempt = F.col("payload.attempt_id")
    usable = events.where(F.col("job_id").isNotNull() & attempt.isNotNull() & (F.trim(F.regexp_replace(attempt, r"\s", "")) != ""))
    fields = [x.split(" ") for x in SCHEMAS["attempt"].split(", ")]
    known = set(events.schema["payload"].dataType.names)
    last = usable.groupBy(F.col("job_id").alias("parent_id"), attempt.alias("child_key")).agg(F.max_by(F.struct("payload.*"), "sequence").alias("p"))
    return last.select("parent_id", "child_key", *[(F.col(f"p.{f}") if f in known else F.lit(None)).cast(kind).alias(f) for f, kind in fields])


def attempt_tables(events: DataFrame) -> DataFrame:
    """The attempts as tagged rows."""
    a = attempts(events)
    return a.select(F.lit("attempt").alias("tag"), "parent_id", "child_key", F.to_json(F.struct(*[c for c in a.columns if c not in ("parent_id", "child_key")])).alias("payload"))


def tagged_tables(jobs: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Every flat table of the job store as one tagged stream."""
    return job_tables(jobs).unionByName(review_tables(reviews)).unionByName(attempt_tables(events))

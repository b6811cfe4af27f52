import json

from vellumine.operators import nested as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, payload string, updated_at string")


def found(df):
    return sorted((r.tag, r.parent_id, r.child_key) for r in df.where("tag not in ('job', 'review')").collect())


JOB = {
    "payload_version": 1, "id": "j", "configuration": {"translation": {"glossary": [["a", "b"], ["c", "d"]]}, "ai": {"components": {"translation": {"model": "m"}, "review": None, "visual": {"model": "v"}}}},
    "stages": [{"kind": "prepare", "artifact_ids": ["x", "y"]}, {"kind": "publish", "artifact_ids": None}], "review_recommendation": {"signal_counts": [["s", 2]]},
}
EXPECTED = sorted([
    ("stage", "j", "prepare"), ("stage", "j", "publish"), ("artifact", "j/prepare", "x"), ("artifact", "j/prepare", "y"), ("glossary", "j", "a"), ("glossary", "j", "c"),
    ("component", "j", "translation"), ("component", "j", "visual_ocr"), ("signal", "j", "s"),
])


def test_shapes_of_one_record(spark):
    camel = {
        "payloadVersion": 1, "configuration": {"translation": {"glossary": {"a": "b", "c": "d"}}, "ai": {"components": {"translation": {}, "visualOcr": {}}}},
        "stages": {"prepare": {"artifactIds": ["x", "y", "x"]}, "publish": {"artifactIds": []}}, "reviewRecommendation": {"signalCounts": {"s": 2}},
    }
    for payload in (JOB, {"job": JOB}, [JOB], json.dumps(JOB), camel, [{"job": camel}]):
        text = json.dumps(payload)
        for t in (text, "﻿" + text, "  " + json.dumps(payload, indent=2) + "\n"):
            assert found(N.job_tables(frame(spark, [("j", t, "2020-01-01T00:00:00Z")]))) == EXPECTED


def test_single_artifact_is_a_string(spark):
    j = json.dumps({"stages": [{"kind": "k", "artifact_ids": "only"}]})
    assert ("artifact", "j", "only") not in found(N.job_tables(frame(spark, [("j", j, None)])))
    assert ("artifact", "j/k", "only") in found(N.job_tables(frame(spark, [("j", j, None)])))


def test_unreadable_and_versions(spark):
    one = lambda k: json.dumps({"stages": [{"kind": k}]})
    rows = [
        ("a", one("old"), "2020-01-01T10:00:00+00:00"), ("a", one("new"), "2020-01-01T06:00:00-05:00"), ("a", one("new")[:-3], "2021-01-01T00:00:00Z"), ("a", one("new"), "2020-01-01T06:00:00-05:00"),
        ("b", None, "2020-01-01T00:00:00Z"), ("c", " ", "2020-01-01T00:00:00Z"), ("d", "null", "2020-01-01T00:00:00Z"), ("e", one("x") + one("y"), "2020-01-01T00:00:00Z"),
        ("f", "[]", "2020-01-01T00:00:00Z"), ("g", "3", None), (None, one("z"), "2020-01-01T00:00:00Z"), ("h", one("h"), "no time"),
    ]
    assert found(N.job_tables(frame(spark, rows))) == [("stage", "a", "new"), ("stage", "h", "h")]


def test_depth_first_order():
    rows = [r[:3] for r in N.visit(JOB, "j", N.JOB)]
    assert rows[:4] == [("stage", "j", "prepare"), ("artifact", "j/prepare", "x"), ("artifact", "j/prepare", "y"), ("stage", "j", "publish")]


def test_attempts(spark):
    rows = [(1, "j", ("a1", "s")), (2, "j", ("a1", "t")), (3, "j", (None, "s")), (4, "j", (" ", "s")), (5, "gone", ("a1", "s")), (6, None, ("a2", "s")), (7, "j", None)]
    e = spark.createDataFrame(rows, "sequence bigint, job_id string, payload struct<attempt_id: string, stage: string>")
    out = N.attempt_tables(e)
    assert found(out) == [("attempt", "gone", "a1"), ("attempt", "j", "a1")]
    flat = N.read_tag(out, "attempt", N.SCHEMAS["attempt"]).where("parent_id = 'j'").collect()
    assert [r.stage for r in flat] == ["t"]


def test_round_trip_by_tag(spark, tmp_path, tiny):
    tagged = N.job_tables(spark.read.parquet(f"{tiny}/jobs.parquet"))
    N.write_tagged(tagged, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == tagged.count() > 0
    jobs = N.read_tag(back, "job", N.SCHEMAS["job"])
    assert jobs.count() == jobs.where("source_path is not null").count() > 0
    stages = N.read_tag(back, "stage", N.SCHEMAS["stage"])
    assert stages.where("kind is null and availability is null").count() == 0


def test_records_of_their_own(spark):
    r = {"id": "r", "jobId": "j", "status": "pending", "createdAt": "2020-01-01", "units": [{"id": "u"}]}
    rows = N.review_tables(frame(spark, [("r", json.dumps({"review": r}), "2020-01-01T00:00:00Z")]))
    one = N.read_tag(rows, "review", N.SCHEMAS["review"]).collect()
    assert [(x.parent_id, x.child_key, x.status, x.created_at) for x in one] == [("j", "r", "pending", "2020-01-01")]


def test_written_once_for_the_same_files(spark, tiny, tmp_path):
    calls = []
    inputs = [spark.read.parquet(f"{tiny}/jobs.parquet")]

    def build():
        calls.append(1)
        return N.job_tables(inputs[0])

    a, b = (N.written_once(build, inputs, str(tmp_path)) for _ in range(2))
    assert len(calls) == 1 and a.count() == b.count() > 0


def test_repeated_rows_and_extra_columns(spark, tiny, clashing):
    from vellumine.plans import QUERIES

    assert sorted(QUERIES["p1_found"](spark, tiny).collect()) == sorted(QUERIES["p1_found"](spark, clashing).collect())

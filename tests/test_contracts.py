"""Each rule by its name, on rows that break just that one."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkassay.__main__ import main
from sparkassay.operators import contracts

FIXTURE = {k: "x" for k in contracts.FIXTURE_TEXTS} | {"source_type": "public_web", "retrieved_at": "2024-01-01T00:00:00Z", "content_digest": "a" * 64, "source_url": "https://a.example/", "private_input_used": False, "predicates": [{"predicate_id": "p", "text": "t"}]}
LABEL = {"question_id": "q", "target_type": "query_natural", "target_id": "t", "value": "Y"}
CANDIDATE = {"question_id": "q", "content_id": "c", "arm": "dense", "content_digest": "b" * 64, "rank_before_dedup": 1}


def violations(spark, check, rows):
    texts = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r.violation for r in check(frame, "raw").orderBy("i").collect()]


def test_fixtures(spark):
    cases = [
        ({}, None), ({"query": ""}, "missing"), ({"predicates": []}, "missing"), ({"query": 5}, "non_empty_strings"), ({"source_type": "web"}, "source_type"), ({"private_input_used": None}, "private_input_used"), ({"private_input_used": "false"}, "private_input_used"), ({"private_input_used": True}, "private_input_used"),
        ({"content_digest": "A" * 64}, "content_digest"), ({"content_digest": "a" * 63}, "content_digest"), ({"retrieved_at": "2024-01-01T00:00:00"}, "retrieved_at"), ({"source_url": "http://a/"}, "source_url"), ({"source_url": 3}, "source_url"), ({"predicates": [{"predicate_id": "p"}]}, "predicates"),
        ({"predicates": [{"predicate_id": "p", "text": "t", "more": 1}]}, "predicates"), ({"predicates": [{"predicate_id": "p", "text": "t", "importance": "odd"}]}, "predicates"), ({"predicates": [3]}, "predicates"), ({"predicates": "p"}, "predicates"), ({"extra": 1}, None), ({"predicates": [{"predicate_id": "p", "text": "t", "importance": "excluded"}]}, None),
    ]
    rows = [FIXTURE | c for c, _ in cases] + [{k: v for k, v in FIXTURE.items() if k != "source_url"}, {k: v for k, v in FIXTURE.items() if k != "source_url"} | {"source_type": "synthetic_template"}, "[1]", "{bad"]
    assert violations(spark, contracts.fixture_violations, rows) == [w for _, w in cases] + ["source_url_missing", None, "not_an_object", "not_an_object"]


def test_labels(spark):
    cases = [({}, None), ({"value": None}, "missing"), ({"note": "x"}, "additional_properties"), ({"free_text": "x"}, "additional_properties"), ({"target_id": 4}, "non_empty_strings"), ({"target_type": "mood"}, "target_type"), ({"value": "y"}, "value"), ({"value": "U"}, "reason_required"), ({"value": "U", "reason": "expertise_missing"}, None), ({"reason": "wording_unclear"}, "reason_without_u"), ({"reason": ""}, None), ({"elapsed_ms": True}, "elapsed_ms"), ({"elapsed_ms": -1}, "elapsed_ms"), ({"elapsed_ms": 1.0}, "elapsed_ms"), ({"elapsed_ms": 0}, None), ({"decision_source": "oracle"}, "decision_source"), ({"confidence": True}, "confidence"), ({"confidence": 1.5}, "confidence"), ({"confidence": 1}, None), ({"confidence": 0.5}, None)]
    assert violations(spark, contracts.label_violations, [LABEL | c for c, _ in cases]) == [w for _, w in cases]


def test_candidates(spark):
    cases = [({}, None), ({"arm": ""}, "missing"), ({"x": 1}, "additional_properties"), ({"content_id": 1}, "non_empty_strings"), ({"arm": "magic"}, "arm"), ({"content_digest": "b"}, "content_digest"), ({"inspection_receipt": 1}, "inspection_receipt"), ({"inspection_receipt": "r"}, None), ({"rank_before_dedup": 0}, "rank_before_dedup"), ({"rank_before_dedup": True}, "rank_before_dedup"), ({"rank_before_dedup": "1"}, "rank_before_dedup")]
    assert violations(spark, contracts.candidate_violations, [CANDIDATE | c for c, _ in cases]) == [w for _, w in cases]


def model_candidate(**change):
    queries = [("natural", "어떤 규칙"), ("mixed", "어떤 rule"), ("spacing_abbreviation", "BG3 규칙"), ("paraphrase", "무슨 규칙")]
    return {"skip": None, "reference_answer": "answer", "predicate": "p", "queries": queries} | change


def with_query(i, kind=None, text=None):
    q = list(model_candidate()["queries"])
    q[i] = (kind or q[i][0], q[i][1] if text is None else text)
    return {"queries": q}


def test_candidate_reasons(spark):
    cases = [({}, "ok"), ({"skip": True}, "explicit_skip"), ({"reference_answer": " "}, "missing_reference_answer"), ({"predicate": None}, "missing_predicate"), ({"queries": None}, "queries_not_four"), ({"queries": model_candidate()["queries"][:3]}, "queries_not_four"), (with_query(0, "other"), "query_item_malformed"), (with_query(0, "mixed"), "kinds_incomplete"), (with_query(0, text="　"), "empty_query_text"), (with_query(0, text="무슨규칙"), "duplicate_query_text"), (with_query(1, text="모두 한글"), "mixed_has_no_latin"), (with_query(2, text="저런규 칙"), "spacing_has_no_marker"), (with_query(2, text="어떤  규칙2"), "ok")]
    rows = [model_candidate(**c) for c, _ in cases]
    frame = spark.createDataFrame([(i, (r["skip"], r["reference_answer"], r["predicate"], r["queries"])) for i, r in enumerate(rows)], f"i int, c struct<{contracts.CANDIDATE.replace('skip boolean', 'skip:boolean').replace('reference_answer string', 'reference_answer:string').replace('predicate string', 'predicate:string').replace('queries array', 'queries:array')}>")
    assert [r.x for r in frame.select("i", contracts.candidate_reason("c").alias("x")).orderBy("i").collect()] == [w for _, w in cases]
    first = F.col("c")
    merged = frame.filter("i < 2").select("i", contracts.merge_passes(first, first).alias("m")).orderBy("i").collect()
    assert (merged[0].m.status, merged[0].m.reasons, merged[0].m.answers) == ("valid", ["ok", "duplicate_of_previous_pass"], ["answer"])
    assert (merged[1].m.status, merged[1].m.answers) == ("explicit_skip", [])


def test_modes_and_projection(spark):
    n = spark.createDataFrame([(12,), (11,), (13,), (1000,)], "n int").select(contracts.mode_violation("smoke", F.col("n")).alias("v")).collect()
    assert [r.v for r in n] == [None, "too_few", "not_a_multiple_of_four", None]
    with pytest.raises(ValueError):
        contracts.mode_violation("other", F.lit(1))
    rows = spark.createDataFrame([("q", "f", "t", "natural", "secret")], "question_id string, fact_cluster_id string, query string, query_kind string, reference_answer string")
    assert contracts.qa_projection(rows).columns == contracts.QA_KEYS[:4]
    with pytest.raises(ValueError):
        contracts.qa_projection(rows.drop("query_kind"))


def test_command_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(LABEL) + "\n\n" + json.dumps(LABEL | {"value": "Z"}) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text(json.dumps(LABEL) + "\n", encoding="utf-8")
    assert main(["validate", "label", str(tmp_path / "a.jsonl")], spark) == 2
    assert main(["validate", "label", str(tmp_path / "b.jsonl")], spark) == 0
    assert main(["scan-canary", '"Z"', str(tmp_path / "a.jsonl")], spark) == 2
    assert main(["scan-canary", "REFERENCE_CANARY", str(tmp_path / "*.jsonl")], spark) == 0
    assert main(["query", "corpus_counts", "/root/testdata/sf0.001", str(tmp_path / "out")], spark) == 0

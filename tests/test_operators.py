"""Review, attempts, measures, references, reports, files and streams on small literal frames."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import rewrite
from sparkassay.operators import blockmax, contracts, corpus, metrics, reference, report, retrieval, review, runlog
from sparkassay.sources import jsonl, providers
from sparkassay.streaming import logs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- retrieval ---------------------------------------------------------------------------------------


def test_bm25_against_plain_scoring(spark):
    rng = random.Random(1)
    words = ["turn", "based", "combat", "Romance", "companion", "3.5", "x-y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(99, "...")]
    questions = [(1, "combat combat Turn"), (2, "unknown"), (3, "x-y 3.5")]
    got = retrieval.bm25(frame(spark, docs, "doc_id bigint, text string"), frame(spark, questions, "question_id bigint, query string"), 4).collect()
    bags = {i: Counter(t.lower().split()) if t != "..." else Counter() for i, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    for q, text in questions:
        want = []
        for i, bag in bags.items():
            score = 0.0
            for t in text.lower().split():
                df = sum(t in b for b in bags.values())
                if bag[t]:
                    score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / max(1, mean)))
            if score:
                want.append((-round(score, 8), i))
        assert [(r.rank, r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.question_id == q] == [(n, i, pytest.approx(-s, abs=2e-8)) for n, (s, i) in enumerate(sorted(want)[:4], 1)]


@pytest.mark.parametrize("options", [{}, {"turn": 12, "block": 30}, {"block": 1}])
def test_ranked_search_by_blocks(spark, options):
    """Every pair scored plainly: ties, copies, null ids and texts, questions without terms; many pairs are not scored."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rare = lambda: words[min(59, int(rng.expovariate(0.08)))]
    docs = [(i, [rare() for _ in range(rng.randint(0, 40))]) for i in range(300)]
    docs += [(i, docs[7][1]) for i in range(400, 430)] + [(None, docs[8][1]), (None, docs[7][1]), (500, None), docs[9]]
    asked = [(q, t, rng.randint(1, 2)) for q in range(12) for t in {rare() for _ in range(rng.randint(1, 9))}] + [(50, "unheard of", 1)]
    d, a = frame(spark, docs, "doc_id bigint, tokens array<string>").repartition(2), frame(spark, asked, "question_id bigint, term string, mult bigint")
    got = blockmax.search(d, a, 4, **options).collect()
    bags = [(i, Counter(t or []), len(t or [])) for i, t in docs]
    n, mean = len(docs), sum(x for _, _, x in bags) / len(docs)
    df = Counter(t for _, c, _ in bags for t in c)
    want = []
    for q in {q for q, _, _ in asked}:
        score = {j: sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.5 * c[t] / (c[t] + 1.5 * (0.25 + 0.75 * x / mean)) for p, t, m in asked if p == q and t in c) for j, (_, c, x) in enumerate(bags)}
        best = sorted((-round(s, 8), bags[j][0] is None, bags[j][0] or 0) for j, s in score.items() if s)[:4]
        want += [(q, r, None if none else i, round(-s, 6)) for r, (s, none, i) in enumerate(best, 1)]
    assert sorted(((r.question_id, r.rank, r.doc_id, round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)


def test_most_pairs_are_not_scored(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    pick = lambda: words[min(399, int(rng.expovariate(0.01)))]
    docs = [(i, [pick() for _ in range(80)]) for i in range(3000)]
    asked = [(q, t, 1) for q in range(10) for t in {pick() for _ in range(30)}]
    got = blockmax.found(frame(spark, docs, "doc_id bigint, tokens array<string>").coalesce(1), frame(spark, asked, "question_id bigint, term string, mult bigint"), 5, block=512)
    assert got.first().scored < 0.1 * 3000 * 10
    assert blockmax.search(frame(spark, [], "doc_id bigint, tokens array<string>"), frame(spark, [], "question_id bigint, term string, mult bigint"), 5).count() == 0


def test_evidence_answers_and_pool(spark):
    docs = frame(spark, [(1, "t", "a  body. More", "https://a/1"), (2, "u", "b", "https://a/2")], "doc_id bigint, title string, body string, source_url string")
    hits = frame(spark, [(7, 1, 2, 2.0), (7, 2, 1, 1.0)], "question_id bigint, rank bigint, doc_id bigint, score double")
    found = retrieval.gathered(retrieval.evidence(hits, docs))
    ids = [h.content_id for h in found.first().retrieval]
    assert ids[0].startswith("doc:2:chunk:0:sha256:") and found.first().retrieval[1].excerpt == "a body. More"
    cited = found.select(retrieval.cite(F.array(F.lit("C2"), F.lit("C9")), F.col("retrieval")).alias("c")).first().c
    assert cited == [ids[1], "C9"]
    answers = providers.answer(found).first()
    assert (answers.status, answers.answer, answers.citations) == ("answered", "b", ["C1"])
    cases = [("answered", "x", ["C1"], True), ("answered", " ", ["C1"], False), ("answered", "x", [], False), ("answered", "x", ["C3"], False), ("abstain", "", [], True), ("abstain", "x", [], False), ("other", "x", ["C1"], False), ("answered", None, ["C1"], False)]
    rows = frame(spark, [(i, *c[:3]) for i, c in enumerate(cases)], "i int, s string, a string, c array<string>")
    valid = rows.select("i", retrieval.valid_answer(F.col("s"), F.col("a"), F.col("c"), F.array(F.lit("C1"), F.lit("C2"))).alias("v")).orderBy("i").collect()
    assert [r.v for r in valid] == [c[3] for c in cases]
    arms = frame(spark, [("q", f"c{i}", "lexical", i) for i in range(1, 8)] + [("q", "c3", "dense", 1), ("q", "d1", "dense", 2), ("q", "d2", "dense", 3)], "question_id string, content_id string, arm string, rank int")
    cards = retrieval.pool(arms).collect()
    assert len(cards) == 8 and {c.card for c in cards} == set(range(1, 9)) and [(c.arm, c.rank_before_dedup) for c in cards if c.content_id == "c3"] == [("dense", 1)]


def test_corpus(spark):
    chunks = frame(spark, [(1, 1, 0, "t", "x" * 120, "https://a/", "h"), (2, 1, 1, "t", "short", "", "h"), (3, 9, 0, "t", "x" * 200, None, "h")], "chunk_id int, document_id int, chunk_number int, title string, body string, source_url string, content_hash string")
    documents = frame(spark, [(1, "r", None, "l", "https://b/")], "document_id int, retrieved_at string, modified_at string, license_url string, source_url string")
    row = corpus.load_chunks(chunks, documents.drop("source_url")).collect()
    assert [(r.chunk_id, r.source_revision, r.content_id) for r in row] == [(1, "r", "doc:1:chunk:0:sha256:h")]
    assert corpus.integrity(chunks, documents).first().orphans == 1
    urls = corpus.source_urls(documents, chunks)
    assert sorted(r.source_url for r in urls.collect()) == ["https://a/", "https://b/"] and corpus.outside(urls, ["a"]).count() == 1


# -- review ------------------------------------------------------------------------------------------


def plain_reduction(events):
    active = {}
    for seq, key, action, value in sorted(events):
        active.pop(key, None)
        if action == "label":
            active[key] = (seq, value)
    return active


def test_events_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    events = [(i, f"q{rng.randint(0, 30)}", rng.choice(["label", "label", "undo"]), rng.choice("YNU")) for i in range(400)]
    rng.shuffle(events)
    want = plain_reduction(events)
    rows = frame(spark, [(s, k, "t", k, a, v) for s, k, a, v in events], "seq bigint, question_id string, target_type string, target_id string, action string, value string")
    active = review.reduce_events(rows, "value")
    assert {r.question_id: (r.seq, r.value) for r in active.collect()} == want
    placed = sorted(review.label_order(active).collect(), key=lambda r: r.place)
    assert [r.question_id for r in placed] == list(want) and [r.place for r in placed] == list(range(1, len(want) + 1))
    for i in range(4):  # files arrive in an odd order
        rows.selectExpr("question_id as key", "seq", "action", "value").filter(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("key string, seq bigint, action string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = logs.standing(logs.drain(spark, logs.latest(stream), str(tmp_path), "update"))
    assert {r.key: (r.seq, r.value) for r in got.collect()} == want


def test_queue_overlay_and_approval(spark):
    fixtures = frame(spark, [("q2", "f1", 2), ("q1", "f1", 1), ("q3", "f2", 3)], "question_id string, fact_cluster_id string, pos int")
    order = [(r.target_type, r.target_id) for r in review.queue(fixtures).orderBy("pos", "kind").collect()]
    assert order == [("reference_supported", "f1"), ("query_natural", "q1"), ("query_natural", "q2"), ("reference_supported", "f2"), ("query_natural", "q3")]
    key = "question_id string, target_type string, target_id string"
    active = frame(spark, [("q1", "t", "a", 1, "Y")], f"{key}, seq int, value string")
    pre = frame(spark, [("q1", "t", "a", 0, "N", "d"), ("q2", "t", "b", 2, "N", "x"), ("q2", "t", "b", 1, "U", "d")], f"{key}, pos int, value string, decision_source string")
    assert sorted(tuple(r) for r in review.overlay(active, pre).collect()) == [("q1", "t", "a", "Y", "human"), ("q2", "t", "b", "U", "d")]
    assert review.orphans(pre, active).count() == 2
    rows = [(f"{c}{i}", c) for c in "abcd" for i in range(4)] + [("e0", "e")]
    labels = [("query_natural", q, "Y", 1) for q, _ in rows] + [("query_natural", "b2", "N", 2), ("query_natural", "c1", "N", 0)] + [("reference_supported", c, "N" if c == "d" else "Y", 1) for c in "abcde"]
    approved = review.approved(frame(spark, rows, "question_id string, fact_cluster_id string"), frame(spark, labels, "target_type string, target_id string, value string, seq int"))
    assert sorted(r.fact_cluster_id for r in approved.collect()) == ["a", "c"]


def test_consensus(spark):
    cases = [("정상 질문", "answer", "N", "N", "local_model_consensus"), ("질문은", "x", "N", "Y", None), ("漢字 질문입니다", "x", "Y", "Y", "deterministic"), ("what is Long Answer", "long answer", "Y", "Y", "deterministic"), ("ab", "x", "U", "U", "deterministic"), ("질문 셋", "x", "Y", "Y", None)]
    rows = frame(spark, [(i, *c[:4]) for i, c in enumerate(cases)], "i int, q string, a string, x string, y string")
    got = rows.select("i", review.consensus(review.rejected_outright(F.col("q"), F.col("a")), F.col("x"), F.col("y")).alias("c")).orderBy("i").collect()
    assert [r.c.decision_source if r.c else None for r in got] == [c[4] for c in cases]


# -- attempts ----------------------------------------------------------------------------------------


def test_attempts(spark):
    rows = [("a", 1, "error", "r"), ("a", 2, "error", "r"), ("a", 3, "success", "r"), ("a", 4, "error", "r"), ("a", 5, "error", "r"), ("a", 6, "error", "r"), ("a", 7, "error", "r"), ("b", 1, "error", "old"), (None, 2, "error", "r")]
    log = frame(spark, rows, "question_id string, seq int, status string, run_fingerprint string")
    errors = runlog.error_counts(log, "r")
    assert [tuple(r) for r in errors.collect()] == [("a", 6)]
    questions, done = frame(spark, [("a",), ("b",), ("c",)], "question_id string"), frame(spark, [("c",), ("c",)], "question_id string")
    assert [r.question_id for r in runlog.pending(questions, done, errors).collect()] == ["b"]
    assert sorted((r.question_id, r.exhausted) for r in runlog.verdict(questions, done, errors).collect()) == [("a", True), ("b", False)]
    assert [tuple(r) for r in runlog.breaker(log, "question_id").collect()] == [("a", 6)]


def test_numbers_and_pages(spark):
    ids = random.Random(5).sample(range(100_000), 250)
    got = runlog.paged(runlog.numbered(frame(spark, [(i,) for i in ids], "id bigint"), "id"), 100).orderBy("number").collect()
    assert [r.id for r in got] == sorted(ids) and [r.number for r in got] == list(range(1, 251))
    assert {r.filename for r in got} == {"cases-0001-0100.md", "cases-0101-0200.md", "cases-0201-0250.md"}


# -- measures ----------------------------------------------------------------------------------------


def test_nearest_rank(spark):
    rng = random.Random(6)
    groups = {g: [rng.choice([1.0, 2.5, rng.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 3), ("c", 10), ("d", 101))}
    rows = frame(spark, [(g, v) for g, vs in groups.items() for v in vs] + [("c", None)], "g string, v double")
    for r in metrics.nearest_rank(rows, "g", "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect():
        ordered = sorted(groups[r.g])
        assert [r.p50, r.p95, r.top] == [ordered[int((len(ordered) - 1) * p)] for p in (0.5, 0.95, 1.0)]


def test_matches_and_gates(spark):
    rows = [("q", 1, "a", "x"), ("q", 2, "a", "y"), ("q", 3, "b", "x"), ("q", 4, "a", "z"), ("p", 1, "a", "x"), ("p", 2, "c", "y")]
    compared = metrics.matches(frame(spark, rows, "question_id string, iteration int, retrieval string, answer string"))
    assert {r.phase: (r.comparisons, r.retrieval_rate, r.answer_rate) for r in metrics.match_rates(compared).collect()} == {"fixed_seed_reproducibility": (1, 0.0, 1.0), "varied_seed_robustness": (3, pytest.approx(2 / 3, abs=1e-8), 0.0)}
    assert metrics.distinct_answers(compared).first().unique_signatures == 3
    gates = frame(spark, [(0, 14400.0, 2, 1), (1, 10.0, 1, 1), (2, 10.0, 2, 1), (3, 14400.0, 2, 0)], "i int, t double, f int, v int")
    got = gates.select("i", metrics.soak_gate(F.col("t"), F.col("f"), F.col("v")).alias("g"), metrics.soak_gate(F.col("t"), F.col("f"), F.col("v"), True).alias("s")).orderBy("i").collect()
    assert [r.g.exit_reason for r in got] == ["completed", "duration_below_14400,phase_coverage_insufficient", "duration_below_14400", "phase_coverage_insufficient"] and all(r.s.formal_gate_passed for r in got)
    w = frame(spark, [(8, 10), (0, 0)], "h int, n int").select(metrics.wilson(F.col("h"), F.col("n")).alias("w")).collect()
    assert (w[0].w.low, w[0].w.high) == (pytest.approx(0.4901, abs=1e-3), pytest.approx(0.9433, abs=1e-3)) and w[1].w is None


def test_nearest_rank_of_a_large_group(spark):
    """More distinct values than cells, hot ones and outliers, a null group."""
    rng = random.Random(9)
    groups = {"a": [rng.choice([1.5, rng.random(), rng.random() * 1e9]) for _ in range(900)], None: [float(i) for i in range(500)]}
    rows = frame(spark, [(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    names = {f"p{i}": i / 20 for i in range(21)}
    got = {r.g: r for r in metrics.nearest_rank(rows, "g", "v", names).collect()}
    for g, vs in groups.items():
        assert got[g].n == len(vs) and [got[g][x] for x in names] == [sorted(vs)[int((len(vs) - 1) * p)] for p in names.values()]


def test_numbers_with_outliers_and_ties(spark):
    rng = random.Random(10)
    values = [rng.choice([5, 6, rng.randint(0, 1000)]) for _ in range(700)] + [10**15, -(10**15)]
    rows = frame(spark, [(v, i) for i, v in enumerate(values)], "v bigint, i int")
    got = {r.i: r.number for r in runlog.numbered(rows, "v", "i").collect()}
    assert [got[i] for i in sorted(got, key=lambda i: (values[i], i))] == list(range(1, 703))
    assert runlog.numbered(rows.limit(0), "v").count() == 0


def test_bootstrap_and_verdicts(spark):
    groups = [(i, (i * 7) % 11, 10) for i in range(40)]
    rate = lambda h, n: round(h / n, 8)
    drawn = []
    for i in range(200):
        h = n = 0
        for g, hits, size in groups:
            key = hashlib.sha256(f"{g}|{hits}|{size}".encode()).hexdigest()
            u = int(hashlib.sha256(f"7|{key}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            w, upto, p = 0, 0.0, math.exp(-1)
            for k in range(12):
                upto += p
                w += u >= upto
                p /= k + 1
            h, n = h + w * hits, n + w * size
        drawn.append(rate(h, n))
    drawn.sort()
    got = metrics.bootstrap(frame(spark, groups, "g int, h int, n int"), "h", "n").first()
    assert tuple(got) == (40, rate(sum(g[1] for g in groups), 400), drawn[int(199 * 0.025)], drawn[int(199 * 0.975)]) and got.low < got.rate < got.high
    reviews = frame(spark, [("a", "Y"), ("a", "U"), ("a", "U"), ("b", "N"), ("c", "U"), ("c", "U"), ("c", "U"), ("c", "Y")], "t string, v string")
    assert {r.t: r.rejected for r in metrics.transform_verdict(reviews, "t", "v").collect()} == {"a": False, "b": True, "c": True}


# -- references and reports --------------------------------------------------------------------------


def test_report_gate_and_labels(spark):
    labels = frame(spark, [("reference_supported", "f", "N", 1), ("reference_supported", "f", "Y", 2)], "target_type string, target_id string, value string, pos int")
    fixtures = frame(spark, [("q", "f", "independent_web_verified"), ("r", "g", None)], "question_id string, fact_cluster_id string, reference_provenance string")
    rows = {r.question_id: r for r in report.with_labels(fixtures, labels).collect()}
    assert (rows["q"].review, rows["q"].natural, rows["r"].review) == ("Y", "pending", "pending")
    cases = [("N", "independent_web_verified", True, "GENERATED"), ("Y", "independent_web_verified", True, "INDEPENDENT"), ("Y", "independent_web_verified", False, "APPROVED"), ("Y", "same_source_web_refreshed", False, "REFRESHED"), ("Y", None, None, "APPROVED")]
    got = frame(spark, [(i, *c[:3]) for i, c in enumerate(cases)], "i int, r string, p string, t boolean").select("i", report.reference_label(F.col("r"), F.col("p"), F.col("t")).alias("x")).orderBy("i").collect()
    assert all(r.x.startswith(c[3]) for r, c in zip(got, cases))
    gate = lambda f, t, ls: report.full_gate(f, frame(spark, [(x,) for x in t], "fact_cluster_id string"), frame(spark, ls, "target_type string, target_id string, value string, decision_source string, pos int")).first().violation
    one = fixtures.filter("question_id = 'q'")
    yes = [("reference_supported", "f", "Y", None, 1), ("query_natural", "q", "Y", "human", 1)]
    assert gate(one, ["f"], yes) is None and gate(one, [], yes) == gate(one, ["f", "g"], yes) == "independent_reference_required"
    assert gate(one, ["f"], yes[:1]) == "y_review_required" and gate(one, ["f"], [yes[0], ("query_natural", "q", "Y", "deterministic", 1)]) == "human_review_required"
    sets = report.set_equality(frame(spark, [(1,), (2,)], "i int"), frame(spark, [(2,), (2,), (3,)], "i int"), "i").first()
    assert tuple(sets) == (1, 1, 1, False)


def test_reports_of_a_thousand_cases(spark, tmp_path):
    hits = "array<struct<rank:bigint,content_id:string,score:double,arm:string,title:string,excerpt:string>>"
    rows = spark.range(1, 1001).selectExpr("id as number", "concat('q', id) as question_id", "'natural' as query_kind", "concat('f', id div 4) as fact_cluster_id", "'a < b' as query", "'ref' as reference_answer", "'T' as source_title", "'https://a/' as source_url", "'Y' as review", "'pending' as natural", f"cast(array() as {hits}) as retrieval", "'abstain' as status", "'' as answer", "cast(array() as array<string>) as citations", "'APPROVED' as reference_label", "array('p') as predicates", "'CC' as license_basis", "'2024-01-01T00:00:00Z' as retrieved_at", "'r<1' as source_revision", "'d' as content_digest", "if(id = 1, null, id) as elapsed_ms", "if(id = 2, 'lost', null) as error", "cast(null as string) as usage")
    cases = runlog.paged(rows.select("number", report.case(rows).alias("markdown")))
    pages = report.pages(cases).orderBy("page").collect()
    assert [p.cases for p in pages] == [100] * 10 and sum(p.body.count("## q") for p in pages) == 1000
    body = pages[0].body
    assert body.startswith("# 질의별 상세 결과\n\n> 이 파일은 `full` 실행의 100개 질의입니다.") and body.endswith("\n")
    assert "- REFERENCE: [T](https://a/) · retrieved 2024-01-01T00:00:00Z · revision r&lt;1 · digest `d`\n" in body
    assert "- RUN: elapsed_ms= · error= · usage={}\n" in body and "- RUN: elapsed_ms=2 · error=lost · usage={}\n" in body
    lines = [r.line for r in report.index(report.pages(cases)).orderBy("place").collect()]
    assert lines[2:5] == ["실행 모드: `full`", "총 질의: 1000", "품질 주장 금지: 아니요"] and len(lines) == 16
    assert lines[6] == f"- [cases-0001-0100.md](cases-0001-0100.md) — 100건 · SHA-256 `{hashlib.sha256(body.encode()).hexdigest()}`"
    assert report.index(report.pages(cases, "smoke"), "smoke").filter("line = '품질 주장 금지: 예'").count() == 1
    report.write_report(report.pages(cases), str(tmp_path / "report"))
    files = {p.parent.name: p.read_text(encoding="utf-8") for p in (tmp_path / "report" / "pages").glob("*/*.txt")}
    assert files["filename=cases-0001-0100.md"] == body and len(files) == 10
    assert [x for p in sorted((tmp_path / "report" / "index").glob("*.txt")) for x in p.read_text(encoding="utf-8").splitlines()] == lines
    with pytest.raises(Exception, match="exists"):
        report.write_report(report.pages(cases), str(tmp_path / "report"))
    assert "a &lt; b" in pages[0].body and "검색 결과 없음" in pages[0].body and "- LOCAL ANSWER: [abstain]\n" in pages[0].body


def test_reference_bundle(spark):
    fixtures = frame(spark, [("f1", 1, "a" * 64, "Some  text", "old", "x", "Y"), ("f1", 2, "b" * 64, "other", "old", "x", "Y"), ("f2", 3, "c" * 64, "t", "old", "x", "Y")], "fact_cluster_id string, pos int, content_digest string, evidence_excerpt string, license_basis string, reference_answer string, reference_review string")
    one = spark.range(1).selectExpr("'f1' as fact_cluster_id", "'new' as reference_answer", "'https://A.example/x' as source_url", "'t' as source_title", "'2024-01-01T00:00:00Z' as retrieved_at", "'r' as source_revision", f"'{'d' * 64}' as content_digest", "'evidence' as evidence_excerpt", "sha2('evidence', 256) as evidence_digest", "'CC' as license_basis", "'different_domain' as source_independence", "false as private_input_used", "array(named_struct('predicate_id', 'p', 'text', 't', 'importance', cast(null as string))) as predicates")
    check = lambda df: [r.violation for r in reference.violations(df, fixtures, ["a.example"]).collect()]
    assert check(one) == [None] and check(one.unionByName(one)) == ["unknown_or_duplicated_cluster"] * 2
    cases = {"missing": ("source_title", "cast(null as string)"), "unknown_or_duplicated_cluster": ("fact_cluster_id", "'f9'"), "domain": ("source_url", "'https://b.example/'"), "content_digest": ("content_digest", "'x'"), "evidence_digest": ("evidence_digest", "'x'"), "retrieved_at": ("retrieved_at", "'2024-01-01'"), "not_public": ("private_input_used", "true"), "source_independence": ("source_independence", "'x'"), "identical_bytes": ("content_digest", f"'{'a' * 64}'")}
    for want, (name, value) in cases.items():
        assert check(one.withColumn(name, F.expr(value))) == [want]
    same = one.withColumn("evidence_excerpt", F.lit(" SOME text ")).withColumn("evidence_digest", F.sha2("evidence_excerpt", 256))
    assert check(same) == ["identical_text"]
    got = {(r.fact_cluster_id, r.pos): r for r in reference.enrich(fixtures, one, "m").collect()}
    row = got["f1", 2]
    assert (row.reference_answer, row.license_basis, row.original_fixture_license_basis, row.reference_provenance) == ("new", "CC", "old", "independent_web_verified")
    assert got["f2", 3].reference_answer == "x" and got["f2", 3].reference_provenance is None and "reference_review" not in row


def test_bindings(spark):
    """Manifests of bundles and triages rule by rule, with the rules that come first deciding; receipts."""
    good = {"bundle_sha256": "'b'", "collection_method": "'independent_public_web'", "public_only": "true", "private_input_used": "false", "license_basis": "'CC'", "local_corpus_sha256": f"'{'1' * 64}'", "reference_snapshot_sha256": f"'{'2' * 64}'", "allowed_domains": "array('a')"}
    struct = lambda m: F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in m.items()) + ")")
    first = lambda c: spark.range(1).select(c.alias("x")).first().x
    check = lambda trusted="m", **odd: first(contracts.bundle_violation(struct(good | odd), F.lit("m"), F.lit(trusted), F.lit("b")))
    assert check() is None and check("other") == "untrusted_manifest" and check(bundle_sha256="'x'") == "bundle_mismatch"
    assert check(collection_method="'search'") == "collection_method" and check(public_only="false") == check(private_input_used="true") == check(private_input_used="cast(null as boolean)") == "not_public"
    assert check(license_basis="''") == "license_basis" and check(reference_snapshot_sha256=good["local_corpus_sha256"]) == check(local_corpus_sha256="'x'") == "same_snapshot"
    assert check(allowed_domains="cast(array() as array<string>)") == "allowed_domains" and check(license_basis="''", public_only="false") == "not_public"
    triage = {"complete": "true", "fixtures_sha256": "'f'", "prelabels_sha256": "'p'"}
    bind = lambda m: first(contracts.triage_binding(struct(m), F.lit("f"), F.lit("p")))
    assert [bind(triage | x) for x in ({}, {"complete": "false"}, {"fixtures_sha256": "'x'"}, {"prelabels_sha256": "'x'"})] == [None, "incomplete", "other_fixtures", "other_prelabels"]
    rows = frame(spark, [(i, "public_web", False, "run") for i in range(9)], "question_id int, source_type string, private_input_used boolean, run_fingerprint string")
    receipt = lambda r, trusted="m": contracts.receipt(r, ["question_id"], F.lit("run"), F.lit(trusted), F.lit("m")).first()
    assert receipt(rows).public_only and receipt(rows) == receipt(rows.repartition(3)) and receipt(rows).fixtures_sha256 != receipt(rows.filter("question_id > 0")).fixtures_sha256
    assert receipt(rows, "x").fixtures_sha256 is None and not receipt(rows.withColumn("source_type", F.lit("private"))).public_only


# -- files and streams -------------------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    rows = frame(spark, [(1, "é\n", None), (2, "x", True)], "b int, a string, c boolean")
    jsonl.write_jsonl(rows.coalesce(1), str(tmp_path / "out"))
    lines = sorted(r.raw for r in jsonl.read_jsonl(spark, str(tmp_path / "out")).collect())
    assert lines == ['{"a":"x","b":2,"c":true}', '{"a":"é\\n","b":1,"c":null}'] and [json.loads(x)["b"] for x in lines] == [2, 1]
    with pytest.raises(Exception, match="exists"):
        jsonl.write_jsonl(rows, str(tmp_path / "out"))
    jsonl.write_jsonl(rows, str(tmp_path / "out"), "append")
    assert jsonl.read_objects(spark, str(tmp_path / "out"), "a string, b int").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n[1]\n"s"\n{bad\n', encoding="utf-8")
    assert [r.valid for r in jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()] == [True, False, False, False]
    with pytest.raises(Exception, match="object required"):
        jsonl.read_objects(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    jsonl.write_manifest(spark, {"n": 1, "가": "x"}, str(tmp_path / "m"))
    assert jsonl.read_manifest(spark, str(tmp_path / "m")) == {"n": 1, "가": "x"}
    (tmp_path / "raw.bin").write_bytes(b"\xff\xfe MARK \xff")
    assert jsonl.canary_files(spark, str(tmp_path / "raw.bin"), "MARK").count() == 1


def test_requests_runs_and_bytes(spark, tmp_path):
    from sparkassay.functions import text as T

    row = frame(spark, [("a b", 1)], "q string, n int").select(T.request_key(F.lit("https://w/api"), {"search": F.col("q"), "limit": F.col("n")}).alias("k"), F.sha2(F.lit("https://w/api?limit=1&search=a+b"), 256).alias("w")).first()
    assert row.k == row.w
    assert [contracts.same_run(*x) for x in ((None, "a", False), (None, "a", True), ("a", "a", True), ("b", "a", True))] == [None, "orphan_artifacts", None, "fingerprint_mismatch"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"123")
    (tmp_path / "b").write_bytes(b"45")
    assert tuple(jsonl.total_bytes(spark, str(tmp_path)).first()) == (2, 5)


def test_streams_resume_and_windows(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 7 as question_id", "cast(1704067200 + id * 10 as timestamp) as ts", "cast(id as double) as value")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert logs.drain(spark, logs.once(stream().select("question_id"), "question_id"), str(tmp_path)).count() == 7
    assert logs.drain(spark, logs.once(stream().select("question_id", "ts"), "question_id", "ts", "1 day"), str(tmp_path)).count() == 7
    events = stream().selectExpr("cast(question_id as string) as key", "cast(value as bigint) as seq", "if(value >= 95, 'undo', 'label') as action", "'Y' as value")
    stand = logs.standing(logs.drain(spark, logs.latest(events), str(tmp_path), "update")).collect()
    assert {r.key: r.seq for r in stand} == {str(i % 7): i for i in range(93, 95)}
    done = logs.drain(spark, logs.windows(stream(), "ts", "value", late="1 day"), str(tmp_path), "update")
    last = done.groupBy("start").agg(F.max("n").alias("n"), F.max("peak").alias("peak")).collect()
    assert sum(r.n for r in last) == 100 and len(last) == 34 and max(r.peak for r in last) == 99


def test_numbers_of_bad_lines_in_files_read_in_parts(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name in ("a", "b c", "d"):
        lines = [rng.choice(['{"x":1}'] * 30 + ["", "[1]", "{bad", '"s"', "  "]) for _ in range(rng.choice([0, 400, 3000]) if name != "a" else 3000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")
        want += [(name, i, "object required" if x in ("[1]", '"s"') else "invalid JSON") for i, x in enumerate(lines, 1) if x.strip() and x[0] != "{" or x == "{bad"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = jsonl.bad_lines(spark, str(tmp_path)).collect()
        assert sorted((r.path.rsplit("/", 1)[1].removesuffix(".jsonl").replace("%20", " "), r.line, r.error) for r in got) == sorted(want)
        first = min(w for w in want if w[0] == "a")
        with pytest.raises(ValueError, match=f"a.jsonl:{first[1]}: {first[2]}"):
            jsonl.read_objects(spark, str(tmp_path), "x int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_canonical_json_of_any_depth(spark):
    texts = ['{"b":{"z":[{"y":1,"x":null}],"a":1.50},"a":1e3}', '{"n":1e16,"m":-0.0,"k":0.1,"l":123456789012345678901}', '{"ü":"\\u00fc\\n","":[]}', None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsonl.canonical_json("t")).collect()]
    assert got == [None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for t in texts]
    nested = spark.sql("select named_struct('q', 1.0d, 'p', array(2, null)) as s, 'x' as a")
    assert nested.select(jsonl.canonical_row(nested)).first()[0] == '{"a":"x","s":{"p":[2,null],"q":1.0}}'


def test_overlap_weighs_terms_by_what_they_replace(spark):
    terms = rewrite.TermMap("v", "approved", en_to_ko={"the": "그것", "of": "소유"}, to_abbreviation={"with": "w/"})
    rows = frame(spark, [("the house of the man",), ("nothing here",), ("with them",), ("of with of",)], "query string")
    got = rewrite.effective_overlap(rows, terms, frame(spark, [("THE",), ("w",)], "term string")).collect()
    assert sorted(tuple(r[c] for c in ("transform_id", "term", "variants", "places", "in_glossary")) for r in got) == [("abbreviation.apply", "with", 2, 2, False), ("mixed.en_to_ko", "of", 2, 3, False), ("mixed.en_to_ko", "the", 1, 2, True)]


def test_blocks_of_postings_are_sealed(monkeypatch):
    """A task holds blocks as compressed bytes, one row each; documents longer than what is numbered at once count whole."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(blockmax, "TOKENS", 7)
    words = ["a", "b", "c", "d"]
    docs = [[words[(i * j) % 5] if (i * j) % 5 < 4 else "other" for j in range(i % 40)] for i in range(300)] + [None]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([*range(299), None, 300], pa.int64()), "tokens": pa.array(docs, pa.list_(pa.string()))})
    *blocks, counts = [r for b in blockmax._pack(SimpleNamespace(value=words), 128)(iter([rows])) for r in b.to_pylist()]
    assert [type(r["block"]) for r in blocks] == [bytes] * 3 and counts["n"] == 301 and counts["words"] == sum(len(d or []) for d in docs)
    assert dict(zip(counts["terms"], counts["ends"])) == {t: sum(w in (d or []) for d in docs) for t, w in enumerate(words)}
    got = set()
    for at, r in zip(range(0, 301, 128), blocks):
        ids, lens, terms, ends, places, tfs = blockmax._opened(pa.scalar(r["block"], pa.binary()))
        assert lens.tolist() == [len(d or []) for d in docs[at : at + 128]] and len(r["block"]) < 8 * len(places) + 4000
        for t, a, z in zip(terms, [0, *ends[:-1]], ends):
            assert list(places[a:z]) == sorted(places[a:z])
            got |= {(at + int(p), words[t], int(f)) for p, f in zip(places[a:z], tfs[a:z])}
    assert got == {(i, w, d.count(w)) for i, d in enumerate(docs) for w in words if d and w in d}

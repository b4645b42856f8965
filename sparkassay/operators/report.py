"""Final reports: exact joins, reference labels, Markdown pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import text as T


def set_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids only on either side, repeated ids on the right, and whether both sets are equal."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer")
    out = both.agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b") > 1).alias("repeated"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0))


def reference_label(review: Column, provenance: Column, trusted: Column) -> Column:
    """How a report names a reference answer."""
    return (
        F.when(F.coalesce(review != "Y", F.lit(True)), "GENERATED REFERENCE CANDIDATE (not independently approved)")
        .when((provenance == "independent_web_verified") & F.coalesce(trusted, F.lit(False)), "INDEPENDENT INTERNET REFERENCE ANSWER")
        .when(provenance == "same_source_web_refreshed", "REFRESHED SAME-SOURCE INTERNET REFERENCE ANSWER")
        .otherwise("APPROVED SYNTHETIC SELF-RETRIEVAL REFERENCE")
    )


def with_labels(fixtures: DataFrame, labels: DataFrame) -> DataFrame:
    """fixtures with the last label of their cluster and of their question, `pending` without one.

    labels: target_type, target_id, value, pos.
    """
    last = labels.groupBy("target_type", "target_id").agg(F.max_by("value", "pos").alias("value"))
    part = lambda kind, key, name: last.filter(F.col("target_type") == kind).select(F.col("target_id").alias(key), F.col("value").alias(name))
    out = fixtures.join(part("reference_supported", "fact_cluster_id", "review"), "fact_cluster_id", "left").join(part("query_natural", "question_id", "natural"), "question_id", "left")
    return out.withColumns({"review": F.coalesce("review", F.lit("pending")), "natural": F.coalesce("natural", F.lit("pending"))})


def case(c: DataFrame) -> Column:
    """Markdown of one case.

    c: question_id, query_kind, fact_cluster_id, query, reference_answer, source_title, source_url, review, natural,
    retrieval (array of hits), status, answer, citations, reference_label, predicates (array of text), license_basis,
    retrieved_at, source_revision, content_digest, elapsed_ms, error, usage.
    """
    hit = lambda h: F.concat(F.lit("  "), h["rank"].cast("string"), F.lit(". `"), T.escape(h["content_id"]), F.lit("` ("), T.escape(h["arm"]), F.lit(", score="), h["score"].cast("string"), F.lit(") — "), T.escape(h["title"]), F.lit(": "), T.escape(h["excerpt"]))
    hits = F.when(F.size("retrieval") > 0, F.array_join(F.transform("retrieval", hit), "\n")).otherwise("  검색 결과 없음")
    citations = F.when(F.size("citations") > 0, F.array_join(F.transform("citations", lambda x: F.concat(F.lit("`"), T.escape(x), F.lit("`"))), ", ")).otherwise("없음")
    predicates = F.when(F.size("predicates") > 0, T.escape(F.array_join("predicates", "; "))).otherwise("없음")
    or_ = lambda x, usual: F.coalesce(x, F.lit(usual))
    line = lambda name, *parts: F.concat(F.lit(f"- {name}: "), *parts)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("question_id"), F.lit(" · "), T.escape("query_kind")),
        F.lit(""),
        F.concat(F.lit("- fact cluster: `"), T.escape("fact_cluster_id"), F.lit("`")),
        line("QUERY", T.escape("query")),
        F.lit("- RESULT:"),
        hits,
        F.rtrim(line("LOCAL ANSWER", F.lit("["), T.escape("status"), F.lit("] "), T.escape("answer"))),
        line("LOCAL CITATIONS", citations),
        F.concat(F.lit("- "), F.col("reference_label"), F.lit(": "), T.escape("reference_answer")),
        line("REFERENCE PREDICATES", predicates),
        line("REFERENCE REVIEW", T.escape("review")),
        line("REFERENCE", F.lit("["), T.escape("source_title"), F.lit("]("), F.col("source_url"), F.lit(") · retrieved "), T.escape("retrieved_at"), F.lit(" · revision "), T.escape("source_revision"), F.lit(" · digest `"), T.escape("content_digest"), F.lit("`")),
        line("SOURCE LICENSE", F.coalesce(T.escape("license_basis"), F.lit("확인 필요"))),
        line("RUN", F.lit("elapsed_ms="), or_(T.escape("elapsed_ms"), ""), F.lit(" · error="), or_(T.escape("error"), ""), F.lit(" · usage="), or_(T.escape("usage"), "{}")),
        line("LABELS", F.lit("reference="), T.escape("review"), F.lit(", query_natural="), T.escape("natural")),
        F.lit(""),
    )


# The texts at the head of a page and of the index.
PAGE_HEAD = [
    "# 질의별 상세 결과",
    "",
    "> 이 파일은 `{mode}` 실행의 {n}개 질의입니다. 독립 인터넷 기준답 실험으로 간주하지 않으며, full run 이전에는 품질 주장을 금지합니다.",
    "",
    "> 데이터 라이선스는 각 case의 SOURCE LICENSE를 따릅니다. 저장소의 MIT 라이선스는 코드에만 적용됩니다.",
    "",
]
INDEX_HEAD = ["# 전체 질의 결과", "", "실행 모드: `{mode}`", "총 질의: {n}", "품질 주장 금지: {no_claim}", ""]


def _filled(lines: list[str], **values: str | Column) -> list[Column]:
    """Lines with columns in the places of their names."""
    out = []
    for text in lines:
        x = F.lit(text)
        for name, value in values.items():
            x = F.replace(x, F.lit("{" + name + "}"), value.cast("string") if isinstance(value, Column) else F.lit(value))
        out.append(x)
    return out


def pages(cases: DataFrame, mode: str = "full") -> DataFrame:
    """(page, filename, cases, sha256, body) of numbered and paged cases (page, filename, number, markdown)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("number", "markdown"))), lambda x: x["markdown"])
    bodies = cases.groupBy("page", "filename").agg(F.count("*").alias("cases"), parts.alias("parts"))
    body = F.array_join(F.concat(F.array(*_filled(PAGE_HEAD, mode=mode, n=F.col("cases"))), F.col("parts")), "\n")
    return bodies.select("page", "filename", "cases", body.alias("body")).withColumn("sha256", T.sha256("body"))


def index(pages: DataFrame, mode: str = "full") -> DataFrame:
    """(place, line): the index's lines in order, with a digest for each page."""
    total = pages.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("n"))
    head = total.select(F.posexplode(F.array(*_filled(INDEX_HEAD, mode=mode, n=F.col("n"), no_claim="아니요" if mode == "full" else "예"))).alias("i", "line"))
    each = F.concat(F.lit("- ["), "filename", F.lit("]("), "filename", F.lit(") — "), F.col("cases").cast("string"), F.lit("건 · SHA-256 `"), "sha256", F.lit("`"))
    return head.select(F.col("i").cast("bigint").alias("place"), "line").unionByName(pages.select((F.col("page") + len(INDEX_HEAD)).alias("place"), each.alias("line")))


def write_report(pages: DataFrame, path: str, mode: str = "full") -> None:
    """A folder for each page with its one file, and the index; the place must be new.  A file's bytes have the digest that the index names."""
    # the writer ends each file with a line end, which bodies have
    pages.select("filename", F.regexp_replace("body", r"\n\z", "").alias("value")).write.mode("errorifexists").partitionBy("filename").text(f"{path}/pages")
    index(pages, mode).orderBy("place").select("line").write.mode("errorifexists").text(f"{path}/index")


def full_gate(fixtures: DataFrame, trusted: DataFrame, labels: DataFrame, by: str | None = None) -> DataFrame:
    """One row: the first rule that forbids a full report, or null; with `by`, a row for each run that fixtures and trusted name there.

    fixtures: question_id, fact_cluster_id, reference_provenance; trusted: fact_cluster_id;
    labels: target_type, target_id, value, decision_source, pos.
    """
    run = [by] if by else []
    last = labels.groupBy("target_type", "target_id").agg(F.max_by(F.struct("value", F.coalesce("decision_source", F.lit("human")).alias("source")), "pos").alias("v"))
    part = lambda kind, key, name: last.filter(F.col("target_type") == kind).select(F.col("target_id").alias(key), F.col("v").alias(name))
    known = trusted.select(*run, "fact_cluster_id", F.lit(True).alias("trusted")).distinct()
    rows = fixtures.join(known, [*run, "fact_cluster_id"], "full_outer").join(part("reference_supported", "fact_cluster_id", "r"), "fact_cluster_id", "left").join(part("query_natural", "question_id", "q"), "question_id", "left")
    no = lambda c: F.count_if(~F.coalesce(c, F.lit(False))) > 0
    out = rows.groupBy(*run).agg(no(F.col("trusted") & (F.col("reference_provenance") == "independent_web_verified")).alias("foreign"), no((F.col("r.value") == "Y") & (F.col("q.value") == "Y")).alias("unreviewed"), no((F.col("r.source") == "human") & (F.col("q.source") == "human")).alias("automatic"))
    return out.select(*run, F.when(F.col("foreign"), "independent_reference_required").when(F.col("unreviewed"), "y_review_required").when(F.col("automatic"), "human_review_required").alias("violation"))

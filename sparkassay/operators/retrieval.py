"""BM25 ranking as joins and aggregates, and the evidence built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators import blockmax
from sparkassay.sources.shared import written

K1, B = 1.5, 0.75


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, idf) over docs (doc_id, text)."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode_outer(F.array_distinct(T.tokens("text"))).alias("term")).filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def length_stats(docs: DataFrame) -> DataFrame:
    """One row: documents and their mean number of tokens."""
    return docs.select(F.size(T.tokens("text")).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def bm25(docs: DataFrame, questions: DataFrame, k: int = 5, digits: int = 8) -> DataFrame:
    """(question_id, rank, doc_id, score): the k best documents of each question.

    A repeated question term counts again; no document without a common term is ranked.  Scores are rounded before ranking, ties
    go to the smaller id.  `sparkassay.operators.blockmax` has the index and the search.
    """
    asked = written(questions.select("question_id", F.explode(T.tokens("query")).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("mult")))
    return blockmax.search(docs.select("doc_id", T.tokens("text").alias("tokens")), asked, k, digits, K1, B)


def evidence(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with citation key, content id, title, excerpt and address.  docs: doc_id, title, body, source_url."""
    return hits.join(docs, "doc_id").select(
        "question_id", "rank", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("citation_key"), T.content_id(F.col("doc_id"), F.lit(0), T.sha256("body")).alias("content_id"), "score", F.lit("lexical").alias("arm"), "title", T.excerpt("body").alias("excerpt"), "source_url", "doc_id"
    )


def gathered(found: DataFrame) -> DataFrame:
    """One row a question with its evidence as an array in rank order; at most k items each."""
    item = F.struct("rank", "content_id", "score", "arm", "title", "excerpt", "source_url")
    return found.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("retrieval"))


def cite(citations: Column, retrieval: Column) -> Column:
    """Citation keys C1.. as content ids; anything else stays as it is."""
    def named(c: Column) -> Column:
        own = F.filter(retrieval, lambda h: F.concat(F.lit("C"), h["rank"].cast("string")) == c)
        return F.coalesce(F.get(own, F.lit(0))["content_id"], c)

    return F.transform(citations, named)


def valid_answer(status: Column, answer: Column, citations: Column, allowed: Column) -> Column:
    """An answer that is answered with text and citations from the evidence, or abstains with neither."""
    known = F.size(F.array_except(citations, allowed)) == 0
    shape = F.when(status == "abstain", (answer == "") & (F.size(citations) == 0)).when(status == "answered", (F.length(T.collapse(answer)) > 0) & (F.size(citations) > 0))
    return F.coalesce(known & shape, F.lit(False))


def source_hits(hits: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Share of questions whose source is among the hits, for each value of `by` and `overall`.  truth: question_id, doc_id and the column `by`."""
    found = truth.join(hits.select("question_id", "doc_id", F.lit(1).alias("hit")), ["question_id", "doc_id"], "left")
    each = found.groupBy("question_id", by).agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    both = each.select("hit", F.explode(F.array(F.col(by), F.lit("overall"))).alias(by))
    return both.groupBy(by).agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 8).alias("rate"))


def pool(arms: DataFrame, cards: int = 8) -> DataFrame:
    """Candidates of all arms (question_id, content_id, arm, rank) as blind cards.

    A candidate found by several arms stays with its best rank; the order of cards hides it.
    """
    best = Window.partitionBy("question_id", "content_id").orderBy("rank", "arm")
    once = arms.withColumn("i", F.row_number().over(best)).filter("i = 1")
    order = Window.partitionBy("question_id").orderBy("rank", "arm", "content_id")
    kept = once.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= cards)
    blind = Window.partitionBy("question_id").orderBy(F.sha2(F.concat_ws("|", "question_id", "content_id"), 256))
    return kept.withColumn("card", F.row_number().over(blind).cast("bigint")).select("question_id", "card", "content_id", "arm", F.col("rank").alias("rank_before_dedup"))


def shingles(tokens: Column, size: int) -> Column:
    """Distinct runs of tokens; fewer tokens are one run."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " "))
    return F.array_distinct(F.when(n > 0, runs).otherwise(F.slice(runs, 1, 0)))


def held_evidence(pairs: DataFrame, evidence: DataFrame, docs: DataFrame, share: float = 0.5, size: int = 5) -> DataFrame:
    """(question_id, doc_id, shared, n): the pairs whose document has at least so much of the question's evidence.

    evidence (question_id, tokens), docs (doc_id, tokens).  With n runs of tokens, share * n must be found: so one of any
    n - share * n + 1 runs is, and of these the rarest are looked for first.  Only the pairs that have one are counted in full.
    """
    wanted = written(evidence.select("question_id", F.explode(shingles(F.col("tokens"), size)).alias("run")))
    known = wanted.select("run").distinct()
    some = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(shingles(F.col("tokens"), size)).alias("run"))
    runs = written(some.join(known, "run", "left_semi"))
    rarity = runs.groupBy("run").agg(F.count("*").alias("df"))
    own = Window.partitionBy("question_id")
    ranked = wanted.join(rarity, "run", "left").withColumns({"n": F.count("*").over(own), "i": F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "run"))})
    ranked = written(ranked.withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("n") * share).cast("int"))))
    first = ranked.filter("i <= n - least + 1").join(runs, "run").select("question_id", "doc_id").distinct().join(pairs.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_semi")
    counted = first.join(ranked, "question_id").join(runs, ["doc_id", "run"]).groupBy("question_id", "doc_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("least").alias("least"))
    return counted.filter("shared >= least").select("question_id", "doc_id", "shared", "n")


def hard_negatives(hits: DataFrame, evidence: DataFrame, docs: DataFrame, k: int = 5, share: float = 0.5, size: int = 5) -> DataFrame:
    """(question_id, rank, doc_id, rank_before, inspection_receipt): the best hits (question_id, rank, doc_id) that do not hold the evidence."""
    hits = written(hits.select("question_id", "rank", "doc_id"))
    left = hits.join(held_evidence(hits, evidence, docs, share, size), ["question_id", "doc_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("bigint")
    receipt = T.sha256(F.concat_ws("|", F.lit("evidence_absent"), F.col("question_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank").cast("string")))
    return left.select("question_id", place.alias("place"), "doc_id", F.col("rank").alias("rank_before"), receipt.alias("inspection_receipt")).filter(F.col("place") <= k).withColumnRenamed("place", "rank")

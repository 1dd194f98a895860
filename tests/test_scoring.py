"""Scores by blocks: the same as by pairs, and no row for each pair."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import scoring, search


def documents(spark):
    rows = [(i, f"{'Order' if i % 3 else 'Region'} pages {i % 7}", f"how orders of region r{i % 5} are listed " * (1 + i % 4)) for i in range(1, 41)]
    return spark.createDataFrame(rows, "doc_id bigint, title string, content string")


def asked(docs):
    return docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query"), F.col("title").alias("text"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_and_best_of_blocks():
    rng = np.random.default_rng(3)
    left, right = (np.where(rng.random(s) < 0.1 + 0.9 * (np.arange(s[1]) < 4), rng.random(s), 0.0) for s in ((50, 30), (20, 30)))
    q, t = np.nonzero(right)
    block = scoring.Terms(q, t, right[q, t], 30, 20)
    r, u = np.nonzero(left)
    scores = block.product(r, u, left[r, u], 50)
    assert np.allclose(scores, left @ right.T)
    top = scoring.Top(20, 3, 0.0, 1)  # one place: many ties
    keys = rng.permutation(50)
    for a in range(0, 50, 7):
        top.add(scores[a : a + 7], keys[a : a + 7])
    want = [(i, k) for i in range(20) for _, k in sorted((-s, k) for s, k in zip(scoring.rounded(scores[:, i], 1), keys, strict=True) if s > 0 or scores[k == keys, i] > 0)[:3]]
    assert list(zip(top.queries, top.keys, strict=True)) == want


def test_hybrid_makes_no_rows_of_words_or_pairs(spark):
    docs = documents(spark)
    found = plan(search.hybrid(docs, asked(docs)))
    assert "MapInArrow" in found and "Generate" not in found and "Join" not in found
    assert found.count("Exchange hashpartitioning") <= 1


def test_related_documents_by_title_make_no_rows_of_pairs(spark):
    docs = documents(spark)
    df = search.hybrid(docs, asked(docs), limit=6, threshold=0.05).where("query <> doc_id")
    counts = {r["query"]: r["count"] for r in df.groupBy("query").count().collect()}
    assert "Join" not in plan(df) and set(counts) == {10, 20, 30, 40} and set(counts.values()) <= {5, 6}


def test_only_repeated_keys_are_gathered(spark, monkeypatch):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 7")).unionByName(documents(spark).where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("bigint")))
    texts = docs.select("doc_id", "title", F.concat_ws(" ", "title", "content").alias("text"))
    got, _ = scoring.corpus(texts, "doc_id", {"orders"})
    # Rows of other keys are not shuffled: the one gathering is fed by a join with the repeated keys.
    found = plan(got)
    assert found.count("Exchange hashpartitioning") == 1 and "LeftSemi" in found.split("Exchange hashpartitioning")[1] and "SortMergeJoin" not in found
    assert got.count() == 41 and got.where("doc_id = 7").select("text").distinct().count() == 1
    few = sorted(tuple(r) for r in search.hybrid(docs, asked(docs), limit=6, threshold=0.05).collect())
    monkeypatch.setattr(scoring, "MOST_KEYS", 0)
    assert few == sorted(tuple(r) for r in search.hybrid(docs, asked(docs), limit=6, threshold=0.05).collect())


def test_reranked_hits_make_no_rows_of_pairs(spark):
    docs = documents(spark)
    df = search.reranked(search.hybrid(docs, asked(docs)))
    assert "Join" not in plan(df) and df.where("score = 1").count() == 4


def test_shuffles_of_repeated_keys_run_once_a_use(spark):
    from siltstone.session import spread

    docs = documents(spark).unionByName(documents(spark))
    texts = docs.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("content")).alias("text"))
    spark.sparkContext.setJobGroup("spread", "plans with shuffles")
    spread(texts)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setJobGroup("", "")
    # To ask a plan for its partitions runs its shuffles.
    assert not jobs
    df = search.reranked(search.hybrid(docs, asked(docs)))
    assert df.where("score = 1").count() == 4 and "SortMergeJoin" not in plan(df)
    assert spread(documents(spark).coalesce(1)).rdd.getNumPartitions() == 3


def test_filtered_documents_make_no_rows_of_pairs(spark):
    docs = documents(spark)
    df = search.hybrid(docs, asked(docs), only=F.col("doc_id") > 20)
    assert "Join" not in plan(df) and df.agg(F.min("doc_id")).collect()[0][0] > 20


def test_filtered_documents_of_repeated_keys(spark):
    rows = [(1, "Order", "pages", "guide"), (1, "The of", "lists", "memo"), (2, "and", "orders order", "guide"), (2, "a", "region", "guide"), (3, "Region", "order", "memo"), (4, "Order", "x1", "guide")]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, content string, kind string")
    queries = spark.createDataFrame([(7, "order"), (7, "the")], "query bigint, text string")
    df = search.hybrid(docs, queries, only=F.col("kind") == "guide")
    # A title or query without words adds no row; a key is kept with all its rows if one of them is.
    assert [(r["query"], r["doc_id"]) for r in df.orderBy(F.desc("score")).collect()] == [(7, 4), (7, 1), (7, 2)]
    assert "SortMergeJoin" not in plan(df)


def test_repeated_keys_are_one_document(spark):
    docs = spark.createDataFrame([(1, "Order", "pages"), (1, "Order", "pages"), (2, "Region", "pages"), (None, "Order", "pages")], "doc_id bigint, title string, content string")
    got = [tuple(r) for r in search.hybrid(docs, spark.createDataFrame([(7, "order")], "query bigint, text string")).collect()]
    idf = lambda df: np.log(5 / (df + 1)) + 1
    want = round(0.7 * idf(2) / np.hypot(idf(2), idf(3)) + 0.3, 6)  # three keys, null too, of four rows
    assert got == [(7, 1, want), (7, 1, want)]


def test_vectors_join_no_pairs(spark):
    docs = documents(spark)
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30, 60)], "doc_id bigint, embedding array<double>")
    q = vectors.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query"), "embedding").join(asked(docs).select("query"), "query", "left_semi")
    df = search.hybrid(docs, asked(docs), vectors, q, limit=80)
    assert "Generate" not in plan(df) and "SortMergeJoin FullOuter" not in plan(df)
    # Vectors of no document count by themselves.
    got = {(r["query"], r["doc_id"]): r["score"] for r in df.collect()}
    assert got[30, 57] == 0.3 and (10, 57) not in got


def test_size_of_a_small_table_is_known(spark):
    from siltstone.session import small_side

    assert small_side(spark.range(3).select("id")).count() == 3


def test_related_texts_make_no_rows_of_pairs(spark):
    docs = documents(spark).select("doc_id", F.col("content").alias("text"))
    df = search.related(docs, F.col("doc_id") % 10 == 0, limit=3)
    assert "Generate" not in plan(df) and "Join" not in plan(df)
    first = {r["query"]: (r["doc_id"], r["score"]) for r in df.collect() if r["score"] == 1.0 and r["doc_id"] % 5 == 0}
    assert set(first) == {10, 20, 30, 40}


def test_titles_meet_without_joins(spark):
    docs = documents(spark)
    assert "Join" not in plan(search.title_boosts(docs, asked(docs)))
    titles = spark.createDataFrame([(1, "Where rows go"), (2, "rows rows"), (3, "Where")], "doc_id bigint, title string")
    # "ere" is a part of a word that says nothing: only the whole query shows it.
    queries = spark.createDataFrame([(7, "ere rows"), (8, "row row x1"), (9, "ere")], "query bigint, text string")
    got = {(r["query"], r["doc_id"]): round(r["boost"], 6) for r in search.title_boosts(titles, queries).collect()}
    assert got == {(7, 1): 1.0, (7, 2): 0.5, (8, 1): 0.666667, (8, 2): 0.666667, (9, 1): 1.0}


def test_hits_are_found_once_before_they_are_filled_up(spark):
    docs = documents(spark)
    near = spark.createDataFrame([(10, 3, 0.9), (10, 4, 0.2)], "query bigint, doc_id bigint, score double")
    df = search.with_fallback(search.hybrid(docs, asked(docs), threshold=0.99), near)
    assert "MapInArrow" not in plan(df) and (10, 3, 0.9) in {tuple(r) for r in df.collect()}

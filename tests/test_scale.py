"""Queries on tables that are dealt over several files, or whose keys go beyond those of the smallest ones."""

import duckdb
from pyspark.sql import functions as F

from lodestone.plans import ORACLES, QUERIES


def same_as_sql(spark, folder, name, tables):
    with duckdb.connect() as c:
        for t in tables:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = c.sql(ORACLES[name])
        want, columns = sorted(got.fetchall(), key=repr), got.columns
    QUERIES[name](spark, str(folder)).write.parquet(f"{folder}/out")
    assert sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").select(columns).collect()), key=repr) == want


def test_fallback_pages_over_several_files(spark, tmp_path):
    names = F.element_at(F.array(*map(F.lit, ("blue part", "blue part 7", "ring"))), (1 + F.col("id") % 3).cast("int"))
    spark.range(0, 60, 1, 4).select(F.col("id").alias("p_partkey"), names.alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, tmp_path, "fallback_pages", ["part"])
    # Spark marks operators that ask for columns their input lacks.
    plan = QUERIES["fallback_pages"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "!" not in plan, plan


def test_induced_subgraph_with_parts_beyond_the_suppliers_offset(spark, tmp_path):
    rows = [(part, supplier) for part in (3, 4, 100_002, 100_004, 100_005) for supplier in (1, 2, 4, 5)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    same_as_sql(spark, tmp_path, "induced_subgraph", ["lineitem"])


def test_composed_texts_are_spread(spark):
    from lodestone.plans import associations, review, structure

    folder = "/root/testdata/sf0.001"
    for rows in (structure._regulations(spark, folder), associations._rules(spark, folder), review._answers(spark, folder), review._records(spark, folder)):
        assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_small_files_of_many_rows_are_not_broadcast(spark, tmp_path):
    import __spark_entry__

    __spark_entry__._prepared(lambda spark, folder: spark.range(1))(spark, "")
    spark.range(300_000).select("id", F.lit("the same words " * 20).alias("text")).write.parquet(f"{tmp_path}/a.parquet")
    rows = spark.read.parquet(f"{tmp_path}/a.parquet")
    plan = rows.join(rows.select("id", F.col("text").alias("other")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_embedding_holds_few_texts_and_terms():
    from lodestone.operators import ranking as R

    assert R._bucket.cache_info().maxsize <= 50_000 and R.TEXT_BLOCK <= 500
    assert R.VECTOR_BLOCK * 256 * 8 <= 1 << 21


def test_terms_are_taken_in_slices_in_order():
    import pyarrow as pa

    from lodestone.operators import reading

    texts = [None if n % 7 == 0 else f"word{n} other" for n in range(600)]
    found = reading.router_features.func(pa.array(texts, pa.string()))
    assert isinstance(found, pa.Array) and found.to_pylist() == [sorted(reading.router_features_of(t)) for t in texts]
    assert reading.router_features.func(pa.array([], pa.string())).to_pylist() == []


def test_origins_and_notices_are_spread(spark):
    from lodestone.plans import origins

    folder = "/root/testdata/sf0.001"
    for rows in (QUERIES["document_origins"](spark, folder), origins._notices(spark, folder)):
        assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_leaves_keep_only_what_moves_on(spark, monkeypatch):
    from lodestone.operators import graph as G

    written, keep = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda rows, name: written.append(out := keep(rows, name)) or out)
    edges = spark.createDataFrame([(n, n + 1) for n in range(1, 12)] + [(20, 21), (21, 20), (30, 31), (30, 32), (31, 33), (32, 33), (33, 34), (30, 34)], "src long, dst long")
    seeds = spark.createDataFrame([(n, n) for n in (1, 5, 12, 20, 30, 99)], "root long, node long")
    assert sorted(map(tuple, G.leaves(edges, seeds, 9).collect())) == [(5, 12), (12, 12), (30, 34), (99, 99)]
    assert sorted(map(tuple, G.leaves(edges, seeds, 11).collect())) == [(1, 12), (5, 12), (12, 12), (30, 34), (99, 99)]
    assert {"on"} <= {c for rows in written for c in rows.columns}


def test_a_small_frontier_needs_no_shuffled_edges(spark, monkeypatch):
    from lodestone.operators import graph as G

    plans, keep = [], G.materialise

    def seen(rows, name):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return keep(rows, name)

    monkeypatch.setattr(G, "materialise", seen)
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (5, 3)], "src long, dst long")
    found = G.reach(edges, spark.range(1, 2).withColumnRenamed("id", "node"), 2, undirected=True)
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1), (3, 2)]
    assert "Aggregate" not in plans[0] and "broadcast" in plans[2]


def test_partitions_grow_with_the_folder(spark, monkeypatch):
    from lodestone import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(session, "INPUT_PART", 1 << 20)
    session.shuffle_sizes(spark, "/root/testdata/sf0.1")
    assert int(spark.conf.get(key)) > 20
    session.shuffle_sizes(spark, "")
    monkeypatch.undo()
    session.shuffle_sizes(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.unset(key)


def test_phrase_points_are_those_of_the_bonus(spark):
    from lodestone.operators import ranking as R

    docs = spark.createDataFrame([(1, "Red rose\nmore of it"), (2, "more\nred ROSE red rose"), (3, None), (4, "rose")], "doc_id long, text string").withColumn("title", F.split("text", "\n")[0])
    asked = spark.createDataFrame([(1, " red rose "), (2, "rose"), (3, " "), (4, "RED rose"), (5, None)], "query_id long, query string")
    want = docs.crossJoin(asked).select("query_id", "doc_id", R.phrase_bonus(F.col("text"), F.col("title"), F.col("query")).alias("points")).where("points > 0")
    assert sorted(map(tuple, R.phrase_points(docs, asked).collect())) == sorted(map(tuple, want.collect()))


def test_context_order_hands_on_places_not_pairs(spark, monkeypatch):
    from lodestone.operators import reading as R

    written, keep = [], R.materialise
    monkeypatch.setattr(R, "materialise", lambda rows, name: written.append(out := keep(rows, name)) or out)
    pages = spark.range(60).selectExpr("0L query_id", "id page", "cast(id as int) place", "cast(id as int) score")
    edges = spark.range(59).selectExpr("id + 1 src", "id dst")
    found = R.context_order(pages, edges)
    assert [r["page"] for r in found.orderBy("rank").collect()] == [59, *range(59)]
    assert max(rows.count() for rows in written) <= 60


def test_pairs_are_summed_where_they_arise(spark):
    from lodestone.operators import ranking as R

    docs = spark.createDataFrame([(n, f"w{n % 7} w{n % 5} w1") for n in range(60)] + [(60, None), (61, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(n, f"w{n} w1 w{n + 2}") for n in range(5)], "query_id long, query string")
    for found in (R.bm25(docs, asked), R.title_overlap(docs, asked)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(query_id" not in plan, plan
        assert found.count() == found.select("query_id", "doc_id").distinct().count() == 300


def test_groups_are_ranked_in_one_reading(spark):
    from lodestone.operators import ranking as R

    rows = [(q, g, k, float((k * 7 + q) % 5)) for q in range(3) for k in range(24) for g in [None if k % 6 == 5 else f"g{k % 6}"]]
    found = R.grouped_top(spark.createDataFrame(rows, "query_id long, source string, doc_id long, score double").repartition(4), 3, "query_id", "source", "doc_id", 2)
    want = []
    for q in range(3):
        groups = {}
        for row in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2])):
            groups.setdefault(row[1], []).append(row)
        want += [(q, g, r[2], hit, place) for place, (g, of) in enumerate(groups.items(), 1) if g and place <= 3 for hit, r in enumerate(of[:2], 1)]
    assert len(want) < 18 and sorted(map(tuple, found.select("query_id", "source", "doc_id", "hit", "place").collect())) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_event_facts_are_sorted_in_more_parts_of_larger_folders(spark, tmp_path):
    import re

    import __spark_entry__

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    with open(tmp_path / "other", "wb") as other:
        other.truncate(80 << 20)
    found = __spark_entry__.queries()["source_event_facts"](spark, str(tmp_path))
    parts = re.findall(r"hashpartitioning\(run_id#\d+L, version_id#\d+L, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
    assert parts and min(map(int, parts)) >= 20, parts
    assert found.count() == 40
    spark.conf.unset(key)


def test_day_words_are_numbered_where_they_arise(spark):
    from lodestone.operators import review as R

    words = ["十二", "2", None, "零", "万", "日", "", "2", "一百零三"]
    rows = spark.createDataFrame(list(enumerate(words)), "n long, word string").repartition(3, "n")
    assert [r["word_value"] for r in R._numbered(rows, "word").orderBy("n").collect()] == [12, 2, None, 0, 10_000, None, None, 2, 103]
    assert R._numbered(rows.where("false"), "word").count() == 0
    records = spark.createDataFrame([(n, 1, n, 0, 0, f"第{n % 5 + 1}日\n管理人支付红利") for n in range(40)], "run_id long, evidence int, version_id long, block_id int, ordinal int, text string")
    found = R.event_facts(records)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(day_word" not in plan, plan
    assert plan.count("ArrowEvalPython") == 1, plan
    assert sorted((r["run_id"], r["day"]) for r in found.collect()) == [(n, n % 5 + 1) for n in range(40)]

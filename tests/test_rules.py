"""Operators whose rules SQL on the star schema hardly touches, on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import curation as C, evidence as E, graph as G, jobs as J
from lodestone.operators.sequences import numbered
from lodestone.sources.text import line_blocks


def test_a_record_lapses_after_it_was_made(spark):
    day = dt.datetime(2024, 1, 1)
    hours = [(1, 0, "a"), (2, 30, "a"), (3, 50, "a"), (4, 53.999, "b"), (5, 54, "b"), (6, 55, "a")]
    rows = [("u", n, day + dt.timedelta(hours=h), sha, day + dt.timedelta(hours=h)) for n, h, sha in hours] + [("v", 9, day, "a", None), ("v", 10, day, "a", None)]
    df = spark.createDataFrame(rows, "user string, request_id long, at timestamp, request_hash string, done_at timestamp").repartition(3)
    found = {r["request_id"]: r["outcome"] for r in J.idempotent(df, ["user"]).collect()}
    assert found == {1: "FIRST", 2: "FIRST", 3: "REPLAY", 4: "CONFLICT", 5: "FIRST", 6: "CONFLICT", 9: "FIRST", 10: "IN_PROGRESS"}
    assert J.idempotent(df.where("false"), ["user"]).count() == 0


def test_deep_chains_have_levels(spark):
    n = 130
    nodes = spark.range(n + 3).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(n, n + 1), (n + 1, n), (n + 1, n + 2), (0, 5), (999, 3)], "src long, dst long"))
    found = {r["node"]: r["level"] for r in G.dag_levels(nodes, edges).collect()}
    assert found == {**{k: k for k in range(n)}, n: None, n + 1: None, n + 2: None}


def test_places_over_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    found = sorted((r["n"], r["a"], r["b"]) for r in numbered(df, "n", "a", "b").collect())
    assert found == [(k + 1, *r) for k, r in enumerate(sorted(rows))]
    assert numbered(df.where("false"), "n", "a").count() == 0


def test_mentions_equal_brute_force(spark):
    names = [(1, "abc"), (2, "abcdefgh"), (3, "defg"), (4, "货币"), (5, "货"), (6, "defg"), (7, "")]
    pages = [(10, "abcdefgh and defg defg 货 货币"), (11, "货币货币 abc abc"), (3, "defg defg"), (12, None), (13, "")]
    want = {}
    for src, text in pages:
        for dst, name in names:
            if not name or (name.isascii() and len(name) < 4) or src == dst:
                continue
            n = (text or "").count(name)
            if n >= 2 or n and len(name) >= 8:
                want[src, dst] = want.get((src, dst), 0) + n
    del want[11, 4]
    df, pg = spark.createDataFrame(names, "dst long, name string"), spark.createDataFrame(pages, "src long, text string")
    known = spark.createDataFrame([(11, 4)], "src long, dst long")
    for block in (1, 1000):
        assert {(r["src"], r["dst"]): r["n"] for r in C.mentions(df, pg, known, block).collect()} == want


def test_quantities_are_scaled(spark):
    row = spark.createDataFrame([("1% 2.5亿元 30天", "100bp, 25000万元 and 30 days", "10万元")], "a string, b string, c string")
    a, b, c = (T.quantities(F.col(x)) for x in "abc")
    found = row.select(E.grounded(a, b).alias("ab"), E.grounded(b, a).alias("ba"), E.grounded(c, b).alias("cb")).first()
    assert tuple(found) == (True, True, False)


def test_titles_of_a_base_and_a_year(spark):
    statements = spark.createDataFrame([(1, 10, 2000), (2, 10, 2001), (3, 20, 1999), (4, 10, 2002), (5, 30, 2000)], "statement long, base long, year int")
    titles = spark.createDataFrame([(100, 10, 2000), (101, 10, 2001), (102, 10, 2001), (103, 20, 2010)], "page long, base long, year int")
    assert sorted(map(tuple, E.title_links(statements, titles).collect())) == [(1, 100), (3, 103)]


def test_lines_have_their_place(spark):
    data = [(1, "a\n\n  \nbé\nc"), (2, None), (3, ""), (4, "\n" * 20_000 + "end")]
    found = sorted((r["doc_id"], r["ordinal"], r["line"], r["char_start"], r["text"]) for r in line_blocks(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert found == [(1, 0, 1, 0, "a"), (1, 3, 4, 6, "bé"), (1, 4, 5, 9, "c"), (4, 20_000, 20_001, 20_000, "end")]


def test_titles_named_and_held(spark):
    titles = [(1, "Rules on fees 2020", "Rules on fees 2020", "Rules on fees", 2020), (2, "Rules on fees 2022", "Rules on fees 2022", "Rules on fees", 2022), (3, "Rules on fees", "Rules on fees", "Rules on fees", None), (4, "Notice: Rules on fees, amended", "Rules on fees, amended", "Notice", None), (5, "Short", "Short", "Short", None), (6, None, None, None, None)]
    t = spark.createDataFrame([(*r, r[4]) for r in titles], "page long, title string, own string, base string, version int, year int")
    named = [(10, "Rules on fees", None, "Rules on fees", 2021, False, "x"), (11, "Rules on fees", 2020, "Rules on fees 2020", 2019, True, "Rules on fees"), (12, "Short", None, "Short", 2021, False, "x"), (1, "Rules on fees", None, "Rules on fees", 2020, False, "x"), (13, "Rules on fees", None, "Rules on fees", None, False, "x")]
    n = spark.createDataFrame(named, "source long, base string, version int, full string, year int, partial boolean, own_base string")
    assert sorted(map(tuple, E.abolitions(n, t).collect())) == [(1, 3, False), (1, 4, False), (10, 1, False), (10, 3, False), (10, 4, False), (13, 1, False), (13, 2, False), (13, 3, False), (13, 4, False)]
    found = sorted(map(tuple, E.publications(n, t).collect()))
    assert found == [(1, 2), (1, 3), (1, 4), (10, 1), (10, 2), (10, 3), (10, 4), (13, 1), (13, 2), (13, 3), (13, 4)]


def test_deletions(spark):
    data = [("abcabc", "aca", True), ("abc", "cab", False), ("abc", "", True), ("", "a", False), ("条款一二", "条二", True), (None, "a", None), ("a", None, None), ("a\nb", "\nb", True)]
    rows = spark.createDataFrame(data, "a string, b string, want boolean").select("want", T.deletions_only(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_titles_are_matched_by_classes_of_pages(spark):
    titles = spark.range(2000).selectExpr("id page", "'the rule 2001' title", "'the rule 2001' own", "'the rule' base", "2001 version", "2001 year")
    named = spark.range(5000, 5003).selectExpr("id source", "'the rule' base", "2001 version", "'the rule 2001' full", "2002 year", "false partial", "'another' own_base")
    rows, pages = E.title_matches(named, titles)
    assert rows.count() == 3 and pages.count() == 2000
    assert E.abolitions(named, titles).distinct().count() == E.abolitions(named, titles).count() == 6000
    assert E.publications(named, titles).count() == 6000

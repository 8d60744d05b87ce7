"""Hand-made cases of core operators."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.operators import catalog as C, curation, evaluation as E, graph as G, jobs as J, ranking as R, sequences as S
from lodestone.sources import text as T
from lodestone.streaming import jobs as SJ

DAY = dt.date(2020, 6, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_as_of_never_falls_back(spark):
    schema = "resource_id int, version_no int, state string, released boolean, valid_from date, valid_to date, applicable boolean, legal_status string, verified boolean, hash_ok boolean"
    early, late = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    ok = ("APPROVED", True, early, None, True, "CURRENT", True, True)
    cases = [
        (1, 1, *ok), (1, 2, "APPROVED", True, early, dt.date(2020, 2, 1), True, "CURRENT", True, True),  # newest expired
        (2, 1, *ok), (2, 2, "APPROVED", True, late, None, True, "CURRENT", True, True),  # future one is skipped
        (3, 1, *ok), (3, 2, "APPROVED", True, early, None, False, "CURRENT", True, True),  # inapplicable one is skipped
        (4, 1, *ok), (4, 2, "APPROVED", True, early, None, None, "CURRENT", True, True),  # unknown newest stops
        (5, 1, *ok), (5, 2, "APPROVED", True, early, None, True, "REPEALED", True, True),  # repealed without an end
        (6, 1, *ok), (6, 2, "DRAFT", True, early, None, True, "CURRENT", True, True),
    ]
    found = C.as_of(spark.createDataFrame(cases, schema), F.lit(DAY))
    assert rows(found.select("resource_id", "version_no")) == [(2, 1), (3, 1), (6, 1)]


def test_applicability_is_three_valued(spark):
    schema = "id int, terms array<struct<group:string,field:string,values:array<string>>>, context map<string,string>"
    both = [("all", "a", ["1"]), ("none", "b", ["2"])]
    cases = [(1, both, {"a": "1", "b": "3"}), (2, both, {"a": "9"}), (3, both, {"a": "1"}), (4, both, {"a": "", "b": "2"}), (5, both, {"a": "1", "b": ""}), (6, [], {})]
    df = spark.createDataFrame(cases, schema).select("id", C.applicable(F.col("terms"), F.col("context")))
    assert rows(df) == [(1, True), (2, False), (3, None), (4, False), (5, None), (6, True)]


def test_empty_access_list_reads_nothing(spark):
    resources = spark.createDataFrame([(1, 1, False, None)], "resource_id int, space_id int, restricted boolean, deleted_at date")
    roles = spark.createDataFrame([(7, 1, [])], "user_id int, space_id int, roles array<string>")
    grants = spark.createDataFrame([], "user_id int, resource_id int, permission string")
    assert C.readable(resources, roles, grants).count() == 0


def test_span_coverage(spark):
    required = spark.createDataFrame([(1, "k", 0, 10), (2, "k", 20, 30), (3, "x", 0, 5)], "span_id int, k string, start int, end int")
    observed = spark.createDataFrame([("k", 1, 0, 4), ("k", 2, 6, 12), ("k", 3, 4, 6), ("k", 4, 0, 10), ("k", 5, 25, 40)], "k string, rank int, `from` int, `to` int")
    got = E.coverage(required, E.span_hits(required, observed, ["k"]))
    assert rows(got.select("span_id", "covered", "first_full_rank", "code")) == [(1, 10, 3, None), (2, 5, None, "SPAN_PARTIAL"), (3, 0, None, "NO_MATCHING_SPAN")]


def test_stage_results_keep_unknown_apart(spark):
    groups = spark.createDataFrame([(1, 1, True, 2), (1, 2, False, None), (2, 1, False, 1)], "case_id int, group_id int, critical boolean, first_full_rank int")
    expected = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    stages = spark.createDataFrame([(1, True), (2, False)], "case_id int, complete boolean")
    got = E.stage_results(expected, groups, stages).select("case_id", "status", "recall", "critical_covered")
    assert rows(got) == [(1, "FAIL", 0.5, True), (2, "UNKNOWN", None, None), (3, "UNKNOWN", None, None)]


def test_roots_and_cycles(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 4), (7, 99)], "node long, target long")
    assert rows(G.roots(p)) == [(1, 1), (2, 1), (3, 1), (4, None), (5, None), (6, None), (7, 99)]


def test_dag_levels_show_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    assert rows(G.dag_levels(nodes, edges)) == [(1, 0), (2, 1), (3, 2), (4, None), (5, None), (6, None)]


def test_claims(spark):
    t = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    jobs = spark.createDataFrame([(1, "QUEUED", None, 0, False), (2, "RUNNING", t(30), 1, False), (3, "RUNNING", t(1), 1, True), (4, "SUCCEEDED", None, 1, False)], "job_id int, state string, lease_until timestamp, attempts int, manual_retry_only boolean")
    asked = spark.createDataFrame([(1, "b", t(5)), (1, "a", t(5)), (2, "a", t(10)), (2, "c", t(40)), (3, "a", t(9)), (4, "a", t(9))], "job_id int, worker string, at timestamp")
    assert rows(J.claims(jobs, asked).select("job_id", "worker", "attempts")) == [(1, "a", 1), (2, "c", 2)]


def test_streaming_claims(spark, tmp_path):
    t = lambda s: dt.datetime(2020, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, "a", "claim", t(0)), (1, "b", "claim", t(5)), (1, "a", "heartbeat", t(30)), (2, "b", "claim", t(1)), (2, "b", "done", t(2)), (2, "c", "claim", t(59))], "job_id long, worker string, action string, at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = SJ.job_states(stream).writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("claims").select("job_id", "worker", "attempts")) == [(1, "a", 1), (2, "b", 1)]


def test_idempotency(spark):
    t = lambda h: dt.datetime(2020, 1, 1, 0, 0, 0) + dt.timedelta(hours=h)
    data = [(1, "u", "x", t(0), t(1)), (2, "u", "x", t(0.5), t(1)), (3, "u", "x", t(2), t(3)), (4, "u", "y", t(3), t(4)), (5, "u", "y", t(25), t(26))]
    df = spark.createDataFrame(data, "request_id int, user string, request_hash string, at timestamp, done_at timestamp")
    assert rows(J.idempotent(df, ["user"]).select("request_id", "outcome")) == [(1, "FIRST"), (2, "IN_PROGRESS"), (3, "REPLAY"), (4, "CONFLICT"), (5, "FIRST")]


def test_similar_titles_match_brute_force(spark):
    titles = ["annual report 2020", "annual report 2021", "anual report 2020", "other", "otter", "a much longer title about reports", "a much longer title about report", "x", ""]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(titles)], "page long, block string, title string")
    want = [(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if titles[i] and titles[j] and SequenceMatcher(None, titles[i], titles[j], autojunk=False).ratio() >= 0.82]
    assert [r[:2] for r in rows(curation.similar_titles(df))] == want


def test_zero_vectors_are_dropped(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [float("nan"), 1.0]), (4, [])], "vec_id int, embedding array<double>")
    asked = df.where("vec_id = 2").select(F.lit(0).alias("query_id"), F.col("embedding").alias("q"))
    assert rows(R.cosine(df, asked).select("vec_id", F.round("score", 6))) == [(2, 1.0)]


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", 1, "a", 5), ("q", 2, "a", 9), ("q", 3, "b", 5), ("q", 4, "a", 1), ("q", 5, "a", 1)], "q string, rank int, v string, size int")
    assert rows(S.greedy_budget(df, "q", ["rank"], "v", "size", 11, 2).select("rank")) == [(1,), (3,), (4,)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\né語😀", max_size=80), st.integers(4, 20), st.integers(0, 3))
def test_byte_chunks_cover(text, budget, overlap):
    parts = T.byte_chunks(text, budget, overlap)
    at = 0
    for a, b in parts:
        assert a <= at < b and len(text[a:b].encode()) <= budget
        at = b
    assert at == len(text)
    assert "".join(T.packets(text, budget)) == text


def test_text_parsers():
    assert T.numeral("一百零二") == 102 and T.numeral("十五") == 15 and T.numeral("两万三千") == 23000 and T.numeral("27") == 27 and T.numeral("x") is None
    assert T.evidence_ids("E3-E5, E2 `E9` and E3") == [3, 4, 5, 2]
    assert [b[:2] for b in T.markdown_blocks("# T\n\npara\nmore\n\n- a\n- b\n\n|a|b|\n|-|-|\n|1|2|\n```\nx\n```")] == [("heading", 1), ("paragraph", 0), ("list", 0), ("table", 0), ("code", 0)]
    assert T.decode("é語".encode("utf-16")) == "é語" and T.decode("中文".encode("gb18030")) == "中文" and T.decode(b"\xef\xbb\xbfa") == "a"
    with pytest.raises(ValueError):
        T.strict_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        T.strict_json("[NaN]")
    with pytest.raises(ValueError):
        T.byte_chunks("😀", 3)

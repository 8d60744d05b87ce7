"""Scoped reads of pages with nested sections."""

from lodestone.operators import reads as R


def test_scoped_reads(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    # Page 1: lines 0-9; section 1 holds 2-7, in it section 2 (4-5) and section 3 (6-7). Page 2 lacks a block, page 3 is read whole.
    blocks = make([(1, f"a{n}", n) for n in range(10)] + [(2, "b0", 0)] + [(3, f"c{n}", n) for n in range(2)] + [(4, "d0", 0)], "page int, block string, ordinal int")
    pages = make([(1, 10), (2, 2), (3, 2), (4, 1)], "page int, block_count int")
    sections = make([(1, 0, 0, 9), (1, 1, 2, 7), (1, 2, 4, 5), (1, 3, 6, 7), (2, 0, 0, 1), (3, 0, 0, 1), (4, 0, 0, 0)], "page int, section int, first int, last int")
    requests = make([(7, 1, 2, False), (7, 3, 1, True), (7, 2, 3, True), (7, 4, 4, False), (8, 1, 1, False), (8, 99, 2, True)], "query_id int, page int, place int, whole boolean")
    relations = make([(3, [(1, "a5"), (2, "b0")]), (9, [(1, "a9")])], "source int, anchors array<struct<page: int, block: string>>")
    found = make([(7, 1, "a4"), (7, 4, "gone"), (8, 1, "a3"), (8, 4, "d0"), (7, 1, None)], "query_id int, page int, block string")
    anchors = R.anchored(requests, relations, found)
    assert sorted(map(tuple, anchors.collect())) == [(7, 1, "a4"), (7, 1, "a5"), (7, 2, "b0"), (7, 4, "gone"), (8, 1, "a3")]
    seen = make([(7, 1, "a4", 5), (7, 9, "z", 6)], "query_id int, page int, block string, evidence int")
    got = [(r["query_id"], r["evidence"], r["block"], r["fresh"]) for r in R.scoped_read(requests, pages, blocks, sections, anchors, seen).orderBy("query_id", "evidence").collect()]
    assert got == [(7, 5, "a4", False), (7, 7, "c0", True), (7, 8, "c1", True), (7, 9, "a0", True), (7, 10, "a1", True), (7, 11, "a2", True), (7, 12, "a3", True), (7, 13, "a5", True)] + [(8, n + 1, f"a{n}", True) for n in range(8)]
    assert sorted(map(tuple, R.left_out(requests, pages, blocks, anchors).collect())) == [(7, 2, "INCOMPLETE"), (7, 4, "NO_ANCHORS"), (8, 99, "INCOMPLETE")]


def test_fill_is_greedy_and_keeps_to_the_budget():
    import random

    page = lambda name, size, sections=(), reducible=True: dict(page=name, bytes=size, sections=list(sections), reducible=reducible)
    a, b, c = page("a", 40), page("b", 70, [(0, 30, 0.5), (1, 25, 0.9), (2, 15, -1.0)]), page("c", 10)
    assert R.fill([[a, b], [c, a]], 120) == {"a": None, "b": None, "c": None}
    assert R.fill([[a, b], [c]], 100) == {"a": None, "b": [0, 1]} and R.fill([[a, b], [c]], 80) == {"a": None, "b": [1], "c": None}
    assert R.fill([[a, page("b", 70, b["sections"], False)], [c]], 100) == {"a": None, "c": None} and R.fill([[b]], 20) == {} and R.fill([], 5) == {}
    rng = random.Random(1)
    for _ in range(200):
        groups = [[page(rng.randrange(9), rng.randint(1, 40), [(i, rng.randint(1, 15), rng.uniform(-1, 1)) for i in range(rng.randrange(4))]) for _ in range(rng.randint(1, 3))] for _ in range(5)]
        known: dict = {}
        groups = [[known.setdefault(p["page"], p) for p in g] for g in groups]
        groups = [list({p["page"]: p for p in g}.values()) for g in groups]
        taken = R.fill(groups, 60)
        used = sum(known[p]["bytes"] if s is None else sum(x[1] for x in known[p]["sections"] if x[0] in s) for p, s in taken.items())
        assert used <= 60 and all(s is None or all(known[p]["sections"][i][2] > 0 for i in s) for p, s in taken.items())
        assert all(known[p]["bytes"] > 60 - used for p in known if p not in taken)


def test_fit_request(spark):
    rows = [(1, "x", 1, False, 1, "a", 1, 40, None, True), (1, "y", 0, False, 9, "b", 1, 30, None, True), (1, "z", 0, True, 10, "c", 2, 50, [(0, 20, 1.0), (1, 30, 2.0)], True), (1, "z", 0, True, 10, "b", 1, 30, None, True), (2, "x", 0, False, 1, "a", 1, 99, None, True)]
    members = spark.createDataFrame(rows, "query_id int, root string, tier int, asked boolean, rank int, page string, place int, bytes int, sections array<struct<index: int, bytes: int, score: double>>, reducible boolean").repartition(3)
    found = R.fit_request(members, spark.createDataFrame([(1, 75), (2, 5)], "query_id int, budget int"))
    assert sorted((r["query_id"], r["page"], r["state"], r["sections"]) for r in found.collect()) == [(1, "a", "LEFT_OUT", []), (1, "b", "WHOLE", []), (1, "c", "PARTIAL", [1]), (2, "a", "LEFT_OUT", [])]

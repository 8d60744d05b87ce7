"""Reading plans against a plain version on random link graphs."""

import random
from collections import defaultdict

import pytest

from lodestone.operators import planning as P


def world(seed):
    rng = random.Random(seed)
    pages = [(p, rng.choice(["knowledge", "document"]), rng.choice([None] * 8 + [rng.randrange(30)])) for p in range(24)]
    kinds = ["CITES", "CITES", "CITES", "REQUIRES", "EXCEPTION_OF", "PRECEDES", "MENTIONS"]
    edges = [(e, rng.randrange(26), rng.randrange(24), rng.choice(kinds), rng.random() < 0.15) for e in range(40)]
    anchors = [(e, rng.choice([s, t, t, t, 25]), f"b{rng.randrange(3)}") for e, s, t, _, _ in edges for _ in range(rng.randrange(3))]
    seeds = [(q, rng.randrange(24), [f"b{b}" for b in range(3) if rng.random() < 0.5]) for q in range(4) for _ in range(rng.randrange(3))]
    eligible = [(q, p, rng.choice([None, rng.randrange(5)]), rng.random() < 0.3) for q in range(4) for p in range(24) if rng.random() < 0.4]
    return pages, edges, anchors, seeds, eligible


def brute(pages, edges, anchors, seeds, eligible, selective):
    kind, canonical = {p: k for p, k, _ in pages}, {p: c for p, _, c in pages if c in {p for p, _, _ in pages}}
    edges = [e for e in edges if e[1] in kind and e[2] in kind]
    at = defaultdict(set)
    for e, p, b in anchors:
        if p in kind and e in {x[0] for x in edges}:
            at[e].add((p, b))
    prints, citing = defaultdict(set), defaultdict(set)
    for e, s, t, k, proposed in edges:
        if proposed:
            continue
        if k == "CITES":
            if kind[s] == "knowledge":
                for p, b in at[e]:
                    if p == t:
                        citing[t, b].add(s)
                if kind[t] != "knowledge":
                    prints[s] |= {("at", t, b) for p, b in at[e] if p == t} or {("at", t, None)}
        elif k in P.FORWARD + P.REVERSE:
            for a, other, side in ((s, t, "source"), (t, s, "target")):
                if kind[a] == "knowledge":
                    prints[a].add((k, side, other))
    out, used = {}, set()
    for q in {s[0] for s in seeds}:
        held = defaultdict(set)
        for x, p, b in seeds:
            if x == q:
                held[p] |= set(b)
        able = {p: (r, strong) for x, p, r, strong in eligible if x == q}
        read, front, n = {p: 0 for p in held}, set(held), 0
        while front:
            n += 1
            links, cited = [], []
            for e, s, t, k, proposed in edges:
                for here, there, on in ((s, t, k in P.FORWARD), (t, s, k in P.REVERSE)):
                    if here in front and on and (not proposed or there in able):
                        links.append((e, there))
                if t in front and k == "CITES" and not proposed and kind[s] == "knowledge":
                    hit = {b for p, b in at[e] if p == t and b in held.get(t, ())}
                    if hit and (not selective or able.get(s, (0, False))[1] or any(len(citing[t, b]) <= 2 for b in hit)):
                        cited.append((e, s))
            if not selective:
                have = set().union(*(prints[p] for p in read))
                good = set()
                for p in sorted({p for _, p in cited}, key=lambda p: (able.get(p, (None,))[0] is None, able.get(p, (0,))[0] or 0, p)):
                    if p in read or not prints[p] or prints[p] - have:
                        good.add(p)
                        have |= prints[p]
                cited = [c for c in cited if c[1] in good]
            links += cited + [(None, canonical[p]) for p in front if p in canonical]
            used |= {(q, *link) for link in links}
            ahead = {p for _, p in links} | {p for e, _ in links if e is not None for p, _ in at[e]}
            front = ahead - set(read)
            read |= dict.fromkeys(front, n)
        blocks = defaultdict(set, {p: set(b) for p, b in held.items()})
        for x, e, _ in used:
            if x == q and e is not None:
                for p, b in at[e]:
                    blocks[p].add(b)
        out |= {(q, p): (n, tuple(sorted(blocks[p]))) for p, n in read.items()}
    return out, used


def frames(spark, world):
    pages, edges, anchors, seeds, eligible = world
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    return (
        make(seeds, "query_id int, page int, blocks array<string>"), make(pages, "page int, kind string, canonical int"), make(edges, "edge int, source int, target int, type string, proposed boolean"),
        make(anchors, "edge int, page int, block string"), make(eligible, "query_id int, page int, rank int, strong boolean"),
    )


@pytest.mark.parametrize(("seed", "selective"), [(1, False), (2, False), (3, True)])
def test_expansion(spark, seed, selective):
    w = world(seed)
    want, links = brute(*w, selective)
    reads, used = P.expand(*frames(spark, w), selective=selective)
    assert {(r["query_id"], r["page"]): (r["round"], tuple(r["blocks"])) for r in reads.collect()} == want
    assert {(r["query_id"], r["edge"], r["page"]) for r in used.collect()} == links
    assert any(n > 1 for n, _ in want.values())


def test_expansion_of_nothing(spark):
    seeds, *rest = frames(spark, world(1))
    reads, used = P.expand(seeds.where("false"), *rest)
    assert reads.count() == 0 and used.count() == 0


def test_greedy_seeds():
    unit = lambda u, page, section, blocks, wiki=False, items=(), reranked=True: dict(unit=u, page=page, section=section, blocks=list(blocks), knowledge=wiki, items=list(items), reranked=reranked)
    units = [unit("a", 1, "s", "x"), unit("b", 1, "s", "y"), unit("c", 1, "t", "z"), unit("d", 2, "w", "p", True, ["i"]), unit("e", 3, "w", "p", True, ["i"]), unit("f", 4, "v", "q", True), unit("g", 5, "o", "r", reranked=False), unit("h", 1, "t", "x")]
    names = lambda most, searches={}: [u for u, _ in P.choose_seeds(units, searches, most)]  # noqa: E731, B006
    assert names(99) == ["a", "c", "d", "f", "b", "g"]  # e brings nothing, h's block is read
    assert names(3) == ["a", "c", "d"] and names(0) == []
    assert P.choose_seeds(units, {"one": ["zz", "e"], "two": ["e", "a"], "three": ["b"]}, 3) == [("e", True), ("b", True), ("c", False)]


def test_unit_seeds(spark):
    _, pages, edges, anchors, _ = frames(spark, ([(1, "document", None), (2, "knowledge", None), (3, "knowledge", None)], [(1, 2, 1, "CITES", False), (2, 3, 1, "CITES", False)], [(1, 1, "b"), (2, 1, "b")], [(0, 1, ["b"])], [(0, 1, 1, True)]))
    units = spark.createDataFrame([(q, u, p, s, b, sc, rr) for q in (1, 2) for u, p, s, b, sc, rr in [("a", 1, "s", ["x"], 0.5, None), ("b", 2, "t", ["y"], 0.9, 0.1), ("c", 3, "u", ["z"], 0.1, 0.7), ("d", 9, "u", ["z"], 0.1, 0.9)]], "query_id int, unit string, page int, section string, blocks array<string>, score double, rerank double")
    searches = spark.createDataFrame([(1, "s", "b", 1), (1, "s", "c", 2), (2, "s", "zz", 1)], "query_id int, search string, unit string, rank int")
    found = P.unit_seeds(units, searches, pages, edges, anchors, 2)
    assert sorted((r["query_id"], r["place"], r["unit"], r["best"]) for r in found.collect()) == [(1, 0, "b", True), (1, 1, "a", False), (2, 0, "c", False), (2, 1, "a", False)]
    seeds = found.select("query_id", "page", "blocks")
    reads, links = P.expand(seeds, pages, edges, anchors, units.select("query_id", "page", P.F.lit(1).alias("rank"), P.F.lit(True).alias("strong")))
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: (r["warnings"], r["sources"], r["wikis"], r["missed"]) for r in P.plan_warnings(queries, reads, links, pages, edges, found, searches).collect()}
    assert got == {1: (["SINGLE_DOCUMENT_COVERAGE_RISK"], 1, 1, 0), 2: (["QUERY_CANDIDATES_DEFERRED", "SINGLE_DOCUMENT_COVERAGE_RISK"], 1, 1, 1), 3: (["NO_READ_CANDIDATES"], 0, 0, 0)}


def test_relevance_seeds(spark):
    rows = [(1, 10, "wiki", 0.9, 0.5, 2, True, ["a", "b"]), (1, 11, "wiki", 0.8, 0.9, 1, True, ["a"]), (1, 12, "source", 0.2, 0.0, 0, True, ["c"]), (1, 13, "source", 0.9, 1.0, 9, False, ["a", "c"]), (1, 14, "wiki", 0.1, 0.0, 0, True, ["d"]), (2, 10, "source", 0.0, 0.0, 0, False, []), (2, 11, "source", 0.1, 0.0, 0, False, [])]
    candidates = spark.createDataFrame(rows, "query_id int, page int, role string, relevance double, hit double, channels int, strong boolean, terms array<string>")
    terms = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "c", 2.0), (1, "d", 0.1), (2, "a", 1.0)], "query_id int, term string, mass double")
    got = sorted(map(tuple, P.relevance_seeds(candidates, terms, most=1).collect()))
    assert got == [(1, 10, 0, "HYBRID_SEED"), (1, 12, 1, "COVERAGE_ESCALATION"), (2, 11, 0, "LOW_RELEVANCE")]


def test_rounds_carry_one_row_for_many_questions(spark, monkeypatch):
    pages = spark.range(20).selectExpr("cast(id as int) page", "'knowledge' kind", "cast(null as int) canonical")
    edges = spark.range(19).selectExpr("cast(id as int) edge", "cast(id as int) source", "cast(id + 1 as int) target", "'REQUIRES' type", "false proposed")
    anchors = edges.selectExpr("edge", "target page", "'b' block")
    seeds = spark.range(100).selectExpr("cast(id as int) query_id", "cast(id % 2 as int) page", "array('b') blocks")
    eligible = seeds.selectExpr("query_id", "page", "1 rank", "true strong")
    written, keep = [], P.materialise

    def counted(rows, name):
        out = keep(rows, name)
        written.extend([out] if name in ("used", "read") else [])
        return out

    monkeypatch.setattr(P, "materialise", counted)
    reads, links = P.expand(seeds, pages, edges, anchors, eligible, selective=True)
    assert sorted((r["query_id"], r["page"]) for r in reads.collect()) == [(q, p) for q in range(100) for p in range(q % 2, 20)]
    assert links.count() == 50 * (19 + 18)
    assert sum(rows.count() for rows in written) <= 2 * 2 * (20 + 19)

"""Links in texts against a catalogue with duplicate, moved, stale and closed pages."""

from hashlib import sha256

from lodestone.operators import navigation as N


def test_inline_links(spark):
    pages = [(1, "knowledge", None, None), (2, "knowledge", 3, None), (3, "document", None, None), (4, "knowledge", None, None), (5, "knowledge", 6, None), (6, "knowledge", 5, None), (7, "knowledge", 8, False), (8, "knowledge", None, None), (9, "document", None, None), (10, "knowledge", 4, None), (11, "knowledge", 99, None)]
    names = [(1, "One"), (2, "Two"), (3, " TWO "), (4, "Four"), (1, "Shared"), (3, "Shared"), (5, "Loop"), (7, "Closed"), (8, "Eight"), (10, "Ten"), (1, "Ten"), (11, "Gone"), (9, ""), (4, "Half"), (1, "Half")]
    body = {1: "[[two]] [[One]] [[Shared|x]] [[Nobody]] ![[Eight]]", 2: "[[ONE]] and [[Shared]]", 3: "[[One]] in a document", 4: "stale", 5: "[[Four]] [[Loop]] [[closed]] [[Ten]] [[Gone]] [[Half]] [[two]]", 8: None, 9: "[[One]]"}
    blocks = [(p, t, sha256((t or "").encode()).hexdigest() if p != 4 else "0") for p, t in body.items() if t is not None] + [(1, "[[Eight]]", sha256(b"[[Eight]]").hexdigest())]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    world = (make(pages, "page int, kind string, canonical int, canonical_open boolean"), make(names, "page int, name string"), make(blocks, "page int, text string, content_sha256 string"))
    found = sorted(((r["page"], r["token"], r["state"], r["target"], r["n_candidates"]) for r in N.inline_links(*world).collect()), key=repr)
    assert found == sorted([
        (1, "two", "LINK", 3, None), (1, "shared", "AMBIGUOUS", None, 2), (1, "nobody", "UNAVAILABLE", None, None), (1, "eight", "LINK", 8, None), (2, "one", "LINK", 1, None), (2, "shared", "AMBIGUOUS", None, 2),
        *((5, t, "UNAVAILABLE", None, None) for t in ("four", "loop", "closed", "ten", "gone", "half")), (5, "two", "LINK", 3, None),
    ], key=repr)
    assert sorted(map(tuple, N.candidates(*world).collect())) == [("shared", 1), ("shared", 3)]
    assert [r["page"] for r in N.invalid_pages(make([(1, None, "x"), (2, "a", sha256(b"a").hexdigest())], "page int, text string, content_sha256 string")).collect()] == [1]

"""Batches of pages merged, and proposals kept, on small fixtures."""

from lodestone.operators import compilation as C


def test_blocks_of_batches(spark):
    blocks = [
        (1, 0, 0, "a", "# A\nfirst", "SUPPORTED", ["e1"]), (1, 1, 0, "a", "# A\n\nsecond", "SUPPORTED", ["e2"]), (1, 2, 0, "a", "  # A\nfirst \n", "SUPPORTED", ["e3", "e1"]), (1, 2, 1, "a", "# only a heading", "SUPPORTED", []),
        (1, 0, 1, "b", "gap", "GAP", ["e4"]), (1, 1, 1, "b", "none", "NOT_APPLICABLE", []), (1, 0, 2, "c", "gap c", "GAP", None), (1, 3, 0, "a", "unsupported", "GAP", ["e9"]),
    ]
    df = spark.createDataFrame(blocks, "page long, batch int, position int, section string, markdown string, status string, evidence array<string>")
    found = sorted((r["section"], r["rank"], r["markdown"], r["status"], r["evidence"]) for r in C.merged_blocks(df).collect())
    assert found == [
        ("a", 1, "# A\nfirst", "SUPPORTED", ["e1", "e3"]), ("a", 2, "second", "SUPPORTED", ["e2"]), ("a", 3, "# only a heading", "SUPPORTED", []),
        ("b", 1, "none", "NOT_APPLICABLE", []), ("c", 1, "gap c", "GAP", None),
    ]


def test_relations_of_batches(spark):
    rows = [(1, 0, 0, "First", "x", "CITES", ["a"]), (1, 1, 0, "Second", "x", "CITES", ["b", "a"]), (1, 1, 1, "First", "Second", "CITES", ["c"]), (2, 0, 0, "Second", "x", "CITES", ["d"])]
    titles = [(1, 0, "First"), (1, 1, "Second"), (2, 0, "Other")]
    found = C.merged_relations(spark.createDataFrame(rows, "page long, batch int, position int, source string, target string, type string, evidence array<string>"), spark.createDataFrame(titles, "page long, batch int, title string"))
    assert sorted(map(tuple, found.select("page", "source", "target", "type", "evidence").collect())) == [(1, "First", "x", "CITES", ["a", "b"]), (2, "Second", "x", "CITES", ["d"])]

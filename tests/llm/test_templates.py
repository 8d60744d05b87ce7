"""Templates of hosts whose pages have very many children."""

import json
import random

from lodestone.llm import extraction


def test_boilerplate_behind_many_children(spark):
    page = lambda n, blocks: "<html><body><article>" + "".join(f"<h2>Part {n} {k}</h2><p>text {n} {k}</p>" for k in range(blocks)) + "<div class=disclaimer>No warranty.</div></article></body></html>"
    data = [(i, f"http://h.example/{i}", page(i, 40)) for i in range(12)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in extraction.main_text(df).collect()}
    assert found == {i: " ".join(f"Part {i} {k} text {i} {k}" for k in range(40)) for i in range(12)}


def test_boilerplate_behind_names_of_single_pages(spark):
    page = lambda n: "<html><body><article>" + "".join(f"<div class='{chr(97 + n)}{chr(97 + k)}x'>own {n} {k}</div>" for k in range(20)) + "<div class=disclaimer>No warranty.</div></article></body></html>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in extraction.main_text(df).collect()}
    assert found == {i: " ".join(f"own {i} {k}" for k in range(20)) for i in range(12)}
    kept = [r["template"] for r in extraction.templates(df).collect()]
    assert len(kept) == 1 and "disclaimer" in kept[0] and "aax" not in kept[0]


def neutral_pages(hosts=2, n=40):
    """Pages without article or main and with names that tell nothing; the main text of each."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    pool = [" ".join(word() for _ in range(9)) for _ in range(4)]
    rows, want = [], {}
    for host in range(hosts):
        for i in range(n):
            title, body = " ".join(word() for _ in range(5)), [" ".join(word() for _ in range(30)) for _ in range(rng.randint(1, 4))]
            links = "".join(f"<li><a href=/{word()}>{word()} {word()}</a></li>" for _ in range(6))
            html = f"<html><body><div class=b1><ul>{links}</ul></div><div class=b2>{rng.choice(pool)}</div><div class=b3><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in body)}<div class=b4>{rng.choice(pool)}</div></div><div class=b5>Printed by us</div></body></html>"
            rows.append((host * 1000 + i, f"http://h{host}.example/{i}", html))
            want[host * 1000 + i] = " ".join([title, *body])
    return rows, want


def test_the_template_finds_the_slot(spark):
    rows, want = neutral_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in extraction.main_text(df).collect()}
    assert found == want
    known = {r["host"]: json.loads(r["template"]) for r in extraction.templates(df).collect()}
    for key, url, html in rows:
        assert extraction.extract(html, known[url.split("/")[2]]) == want[key] != extraction.extract(html, None)


def test_copies_of_a_page_count_once_and_large_hosts_are_split(spark, monkeypatch):
    rows, want = neutral_pages(hosts=1, n=30)
    monkeypatch.setattr(extraction, "COPY_PAGES", 7)
    monkeypatch.setattr(extraction, "SHARE", 1 << 40)
    df = spark.createDataFrame(rows + rows[:3] * 50, "page_id long, url string, html string").repartition(5)
    found = extraction.main_text(df).collect()
    assert len(found) == 180 and all(r["text"] == want[r["page_id"]] for r in found)


def test_deep_nesting_keeps_all_text_in_order():
    deep = lambda n: "".join(f"<div>a{k} " for k in range(n)) + "<b>core</b>" + "".join(f"b{k}</div> " for k in range(n))
    for n in (100, 5000):
        want = " ".join([f"a{k}" for k in range(n)] + [f"coreb{k}" if not k else f"b{k}" for k in range(n)])
        assert extraction.extract(f"<body>{deep(n)}</body>", None) == want
    tree = extraction.shape(extraction.parse(deep(5000)), 1)
    again = extraction.fold(tree, extraction.shape(extraction.parse(deep(4000)), 2))
    assert len(again[1]) == 2
    assert extraction.extract("<table><tr><td>" * 3000 + "x", None) == "x"


def test_tree_matching_equals_its_definition():
    def matching(a, b):
        if a[0] != b[0]:
            return 0
        m = {}
        for i in range(len(a[4]) + 1):
            for j in range(len(b[4]) + 1):
                m[i, j] = 0 if not i or not j else max(m[i - 1, j], m[i, j - 1], m[i - 1, j - 1] + matching(a[4][i - 1], b[4][j - 1]))
        return m[len(a[4]), len(b[4])] + 1

    rng = random.Random(4)

    def tree(depth):
        return [rng.choice("pqr"), [1], 0, False, [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else [], None]

    for _ in range(150):
        a, b = ["x", [1], 0, False, [tree(2) for _ in range(4)], None], ["x", [1], 0, False, [tree(2) for _ in range(4)], None]
        size, pairs = extraction.align(a, b)
        assert size == matching(a, b)
        assert size == 1 + sum(matching(a[4][i], b[4][j]) for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_one_page_of_a_host_without_regions(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<div class=menu><a href=x>menu</a></div><p>Only text.</p>")], "page_id long, url string, html string")
    assert [r["text"] for r in extraction.main_text(df).collect()] == ["Only text."]

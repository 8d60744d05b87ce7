"""Places that texts point to inside themselves, and what has to be read with a section: joins on sections, and a closure."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from lodestone.functions import structure as S
from lodestone.operators.graph import reach
from lodestone.operators.structure import rows_of
from lodestone.session import materialise

#: Families whose numbered items are read together, and the items.
GROUPED = ("article", "item", "subitem")
ITEMS = ("item", "subitem")


def section_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, parent, ancestors (nearest first), family, number, first_line, last_line: nested sections.

    Section 0 is the whole text, without family. The result is written once, as what
    is located or read with a section asks for it several times.
    """

    def found(t: str) -> Iterator[tuple]:
        lines = t.split("\n")
        rows = S.outline(lines)
        above: dict[int, list[int]] = {}
        for n, parent, first, last, title in rows:
            above[n] = [parent, *above[parent]] if parent >= 0 else []
            h = S.heading(title) if n else None
            yield n, parent, above[n], h[1] if h else None, h[2] if h else None, first, last

    return materialise(rows_of(docs, found, "section int, parent int, ancestors array<int>, family string, number int, first_line int, last_line int", key, text), "index")


def pointers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, start, end, kind, title, parts: places that lines point to, outside contents tables.

    kind is path, relative, note or, with a title, external or annex.
    """

    def found(t: str) -> Iterator[tuple]:
        lines = t.split("\n")
        skip = S.contents_lines(lines)
        for n, line in enumerate(lines):
            for a, b, kind, title, parts in () if n in skip else S.locators(line):
                yield n, a, b, kind, title, [{"family": f, "number": v} for f, v in parts]

    return rows_of(docs, found, "line int, start int, end int, kind string, title string, parts array<struct<family: string, number: int>>", key, text)


def owned(places: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """places with owner: the innermost section that holds their line."""
    lines = index.select(key, F.col("section").alias("owner"), F.explode(F.sequence("first_line", "last_line")).alias("line"))
    inner = lines.groupBy(key, "line").agg(F.max("owner").alias("owner"))
    return places.join(inner, [key, "line"])


def locate(places: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, place, status, target: the sections that paths lead to, part by part.

    places: key, place (an id), parts, owner (a section, or null for a path from
    outside). The first part is looked for among all sections of its family and number; if there are several,
    among those that share most ancestors with the owner. Further parts are
    looked for below the one before, at the nearest level. A natural paragraph
    (款) isn't numbered, so it leads to what holds it: BROADER. Else RESOLVED to
    one section, AMBIGUOUS or UNRESOLVED (target null).
    """
    known = materialise(index.where("family is not null").select(key, F.col("section").alias("target"), "ancestors", "family", "number"), "sections")
    of = index.select(key, F.col("section").alias("owner"), F.concat(F.array("section"), "ancestors").alias("around"))
    rows = places.join(of, [key, "owner"], "left").select(key, "place", "parts", F.coalesce("around", F.array().cast("array<int>")).alias("around"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("status"))
    rows = materialise(rows.withColumn("status", F.when(F.size("parts") == 0, "UNRESOLVED")), "places")
    longest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for step in range(longest):
        live = rows.where((F.col("status").isNull()) & (F.size("parts") > step)).withColumn("want", F.element_at("parts", step + 1))
        rest = rows.where((F.col("status").isNotNull()) | (F.size("parts") <= step))
        broad = live.where("want.family = 'paragraph'")
        broad = broad.withColumn("status", F.when(F.col("at").isNull(), "UNRESOLVED").otherwise("BROADER")).drop("want")
        asked = live.where("want.family <> 'paragraph'").withColumn("families", F.when(F.col("want.family") == "item", F.array(*map(F.lit, ITEMS))).otherwise(F.array("want.family")))
        met = asked.join(known.withColumnRenamed("ancestors", "over"), [asked[key] == known[key], F.col("want.number") == F.col("number"), F.array_contains("families", F.col("family"))], "left").drop(known[key])
        inside = F.col("at").isNull() | F.array_contains("over", F.col("at"))
        # How near: ancestors shared with the owner; or, below a part, how few levels lie between.
        near = F.when(F.col("at").isNull(), F.size(F.array_intersect("over", "around"))).otherwise(-F.array_position("over", F.col("at")).cast("int"))
        met = met.withColumn("hit", F.when(F.col("target").isNotNull() & inside, F.struct(near.alias("near"), F.col("target").alias("target"))))
        found = met.groupBy(key, "place", "parts", "around", "at", "step", "status").agg(F.collect_list("hit").alias("hits"))
        best = F.filter("hits", lambda h: h["near"] == F.array_max(F.transform(F.col("hits"), lambda x: x["near"])))
        found = found.withColumn("best", best)
        unique = F.size("best") == 1
        found = found.withColumn("status", F.when(F.size("best") == 0, "UNRESOLVED").when(~unique, "AMBIGUOUS")).withColumn("at", F.when(unique, F.element_at("best", 1)["target"]))
        rows = rest.unionByName(broad).unionByName(found.drop("hits", "best"))
        rows = materialise(rows, "places")
    status = F.coalesce("status", F.lit("RESOLVED"))
    return rows.select(key, "place", status.alias("status"), F.when(status.isin("RESOLVED", "BROADER"), F.col("at")).alias("target"))


def references(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, line, owner, kind, title, status, target: places that texts point to, located where they lead into the text itself.

    Relative ones lead to the neighbour, under the same parent, of the enclosing section of their family.
    External ones and annexes are EXTERNAL, with their title; a note leads to the section
    of its only definition.
    """
    found = owned(pointers(docs, key, text), index, key)
    found = materialise(found.withColumn("place", F.struct("line", "start")), "references")
    paths = locate(found.where("kind = 'path'").select(key, "place", "parts", "owner"), index, key)

    want = F.element_at("parts", 1)
    around = index.select(key, F.col("section").alias("owner"), F.explode(F.concat(F.array("section"), "ancestors")).alias("over"))
    named = index.where("family is not null").select(key, F.col("section").alias("over"), "parent", "family", "number")
    relative = found.where("kind = 'relative'").join(around, [key, "owner"]).join(named, [key, "over"]).where(F.when(want["family"] == "item", F.col("family").isin(*ITEMS)).otherwise(F.col("family") == want["family"]))
    nearest = relative.groupBy(key, "place").agg(F.max_by(F.struct("parent", "family", (F.col("number") + want["number"]).alias("number")), "over").alias("n")).select(key, "place", "n.*")
    beside = nearest.join(named.select(key, "parent", "family", "number", F.col("over").alias("section")), [key, "parent", "family", "number"])
    notes = rows_of(docs, lambda t: ((n, m) for n, line in enumerate(t.split("\n")) for m in _note_definitions(line)), "line int, title string", key, text)
    defined = found.where("kind = 'note'").select(key, "place", "title").join(owned(notes, index, key).select(key, "title", F.col("owner").alias("section")), [key, "title"])
    one = beside.select(key, "place", "section").unionByName(defined.select(key, "place", "section")).groupBy(key, "place").agg(F.count("*").alias("n"), F.max("section").alias("section"))
    others = one.select(key, "place", F.when(F.col("n") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("status"), F.when(F.col("n") == 1, F.col("section")).alias("target"))
    rows = found.join(paths.unionByName(others), [key, "place"], "left")
    status = F.when(F.col("kind").isin("external", "annex"), "EXTERNAL").otherwise(F.coalesce("status", F.lit("UNRESOLVED")))
    return rows.select(key, "place", "line", "owner", "kind", "title", status.alias("status"), "target")


def _note_definitions(line: str) -> list[str]:
    return re.findall(r"^\s*\[\^([^\]\s]+)\]\s*[:：]", line)


def reading_closure(index: DataFrame, refs: DataFrame, seeds: DataFrame, groups: bool = True, key: str = "doc_id") -> DataFrame:
    """key, section: the outermost sections to read for the seeds (key, section).

    A section is read with what it, the sections in it, and the leading lines of
    those around it point to. With `groups` one of several numbered items brings the
    section that lists them, up to the article. Rounds run until nothing is new.
    """
    node = lambda c: F.struct(F.col(key), F.col(c).alias("section"))
    real = refs.where("target is not null and status in ('RESOLVED', 'BROADER')").select(key, "owner", "target").distinct()
    up = index.select(key, F.col("section").alias("owner"), F.explode(F.concat(F.array("section"), "ancestors")).alias("src"))
    down = index.select(key, F.col("section").alias("src"), F.explode("ancestors").alias("owner"))
    links = real.join(up.unionByName(down), [key, "owner"]).select(key, "src", F.col("target").alias("dst"))
    if groups:
        listed = index.where(F.col("family").isin(*ITEMS)).groupBy(key, "parent").agg(F.collect_list("section").alias("items")).where(F.size("items") > 1)
        holders = index.where(F.col("family").isin(*GROUPED)).select(key, F.col("section").alias("parent"))
        links = links.unionByName(listed.join(holders, [key, "parent"]).select(key, F.explode("items").alias("src"), F.col("parent").alias("dst")))
    edges = links.where("src <> dst").select(node("src").alias("src"), node("dst").alias("dst"))
    found = reach(edges, seeds.select(node("section").alias("node")), 1 << 30)
    read = found.select("node.*").distinct()
    inner = read.join(index.select(key, "section", F.explode("ancestors").alias("over")), [key, "section"]).join(read.select(key, F.col("section").alias("over")), [key, "over"], "left_semi")
    return read.join(inner.select(key, "section").distinct(), [key, "section"], "left_anti")

"""Reading what a plan names: whole pages, or the least sections around its anchors, numbered as evidence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.operators.pools import choose


def anchored(requests: DataFrame, relations: DataFrame, discovered: DataFrame) -> DataFrame:
    """query_id, page, block: the anchors of requested pages: blocks that the search found, and those that relations of requested pages rest on.

    relations: source, anchors (array of struct<page, block>); discovered: query_id, page, block.
    """
    asked = requests.select("query_id", "page").distinct()
    linked = asked.join(relations.withColumnRenamed("source", "page"), "page").select("query_id", F.explode("anchors").alias("a")).select("query_id", "a.page", "a.block")
    return linked.unionByName(discovered.select("query_id", "page", "block")).join(asked, ["query_id", "page"], "left_semi").where("block is not null").distinct()


def minimal_sections(anchors: DataFrame, blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, page, first, last: ranges of ordinals to read for anchors (query_id, page, block).

    The smallest section (page, section, first, last) around each anchor, and of all sections
    around that one the lines in front of their first inner section, which introduce it.
    """
    at = anchors.join(blocks.select("page", "block", "ordinal"), ["page", "block"])
    held = at.join(sections, "page").where("ordinal between first and last")
    least = held.groupBy("query_id", "page", "block").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("size"), (-F.col("section")).alias("inner"), "section", "first", "last")).alias("s"))
    chosen = least.select("query_id", "page", "s.section", "s.first", "s.last").distinct()
    inside = lambda a, b: (F.col(f"{a}.first") >= F.col(f"{b}.first")) & (F.col(f"{a}.last") <= F.col(f"{b}.last")) & (F.col(f"{a}.section") > F.col(f"{b}.section"))
    begins = sections.alias("c").join(sections.alias("p"), (F.col("c.page") == F.col("p.page")) & inside("c", "p")).groupBy("p.page", "p.section").agg(F.min("c.first").alias("begins"))
    over = chosen.alias("c").join(sections.alias("p"), (F.col("c.page") == F.col("p.page")) & inside("c", "p")).select("c.query_id", "p.page", "p.section", "p.first")
    leads = over.join(begins, ["page", "section"]).select("query_id", "page", "first", (F.col("begins") - 1).alias("last")).where("first <= last")
    return chosen.select("query_id", "page", "first", "last").unionByName(leads).distinct()


def scoped_read(requests: DataFrame, pages: DataFrame, blocks: DataFrame, sections: DataFrame, anchors: DataFrame, seen: DataFrame) -> DataFrame:
    """query_id, page, block, ordinal, evidence, fresh: the blocks that a plan's requests make a question read.

    requests: query_id, page, place, whole (the page is read whole). pages: page,
    block_count; a page whose readable blocks (page, block, ordinal) aren't as many
    is left out, as part of it can't be read. Other requests read minimal_sections() of their
    anchors. Blocks that a question has seen (query_id, page, block, evidence) keep their
    number; fresh ones get the next, by place, page and ordinal.
    """
    full = blocks.groupBy("page").agg(F.count("*").alias("n")).join(pages, "page").where("n = block_count").select("page")
    asked = requests.groupBy("query_id", "page").agg(F.min("place").alias("place"), F.max("whole").alias("whole")).join(full, "page", "left_semi")
    ranges = minimal_sections(anchors.join(asked.where("not whole").select("query_id", "page"), ["query_id", "page"], "left_semi"), blocks, sections)
    parts = ranges.join(blocks, "page").where("ordinal between first and last").select("query_id", "page", "block", "ordinal").distinct()
    whole = asked.where("whole").select("query_id", "page").join(blocks, "page").select("query_id", "page", "block", "ordinal")
    rows = parts.unionByName(whole).join(asked.select("query_id", "page", "place"), ["query_id", "page"])
    rows = rows.join(seen.select("query_id", "page", "block", "evidence"), ["query_id", "page", "block"], "left")
    last = seen.groupBy("query_id").agg(F.max("evidence").alias("last"))
    order = Window.partitionBy("query_id", F.col("evidence").isNull()).orderBy("place", "page", "ordinal", "block")
    rows = rows.join(last, "query_id", "left").withColumn("next", F.coalesce("last", F.lit(0)) + F.row_number().over(order))
    return rows.select("query_id", "page", "block", "ordinal", F.coalesce("evidence", "next").cast("long").alias("evidence"), F.col("evidence").isNull().alias("fresh"))


def left_out(requests: DataFrame, pages: DataFrame, blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """query_id, page, reason: requests that read nothing: INCOMPLETE pages, and NO_ANCHORS on pages that aren't read whole."""
    counts = blocks.groupBy("page").agg(F.count("*").alias("n"))
    rows = requests.groupBy("query_id", "page").agg(F.max("whole").alias("whole")).join(pages.join(counts, "page", "left"), "page", "left")
    placed = anchors.join(blocks.select("page", "block"), ["page", "block"], "left_semi").select("query_id", "page", F.lit(True).alias("placed")).distinct()
    rows = rows.join(placed, ["query_id", "page"], "left")
    reason = F.when(~(F.coalesce("n", F.lit(0)) == F.coalesce("block_count", F.lit(-1))), "INCOMPLETE").when(~F.col("whole") & F.col("placed").isNull(), "NO_ANCHORS")
    return rows.select("query_id", "page", reason.alias("reason")).where("reason is not null")


def fill(groups: list[list[dict]], budget: int) -> dict[object, list[int] | None]:
    """page -> None (whole) or indexes of its sections, of what fits a request, for groups in their order.

    A group that fits is taken whole, else its pages one by one; of a page that
    doesn't fit the sections of best positive score that do, if it is reducible. What doesn't fit is skipped, and what
    comes later may still fit. pages: page, bytes, sections (index, bytes, score), reducible.
    """
    used, taken = 0, {}
    for group in groups:
        rest = [p for p in group if p["page"] not in taken]
        if used + sum(p["bytes"] for p in rest) <= budget:
            used += sum(p["bytes"] for p in rest)
            taken |= {p["page"]: None for p in rest}
            continue
        for p in rest:
            if used + p["bytes"] <= budget:
                used += p["bytes"]
                taken[p["page"]] = None
            elif p["reducible"] and len(p["sections"]) > 1:
                chosen = []
                for index, size, score in sorted(p["sections"], key=lambda s: (-s[2], s[0])):
                    if score > 0 and used + size <= budget:
                        used += size
                        chosen.append(index)
                if chosen:
                    taken[p["page"]] = sorted(chosen)
    return taken


def fit_request(members: DataFrame, budgets: DataFrame) -> DataFrame:
    """query_id, page, state (WHOLE, PARTIAL or LEFT_OUT), sections: what of the read pages one request holds.

    members: query_id, root, tier, asked, rank, page, place, bytes, sections
    (array<struct<index, bytes, score>>), reducible: pages with their dependency group,
    named by its root. Groups go by tier, asked ones first, then by rank and root; pages
    in a group by place. budgets: query_id, budget. What is left out is listed, none is lost. A
    question's pages meet in one task: they are what one request chooses from.
    """
    page = members.schema["page"].dataType.simpleString()
    order = [F.col("tier").asc_nulls_last(), F.col("asked").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("rank", "root", "place", "page"))]

    def pick(pool: list[dict]) -> Iterator[tuple]:
        groups: dict[object, list[dict]] = {}
        for r in pool:
            sections = [(s["index"], s["bytes"], s["score"]) for s in r["sections"] or ()]
            groups.setdefault(r["root"], []).append(dict(page=r["page"], bytes=r["bytes"], sections=sections, reducible=bool(r["reducible"])))
        taken = fill(list(groups.values()), int(pool[0]["budget"]))
        for p in dict.fromkeys(r["page"] for r in pool):
            yield p, "LEFT_OUT" if p not in taken else "WHOLE" if taken[p] is None else "PARTIAL", taken.get(p) or []

    return choose(members.join(budgets, "query_id"), "query_id", order, pick, f"page {page}, state string, sections array<int>")

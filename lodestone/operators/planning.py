"""Reading plans of many questions at once: seeds among ranked units, then what the links of read pages call for.

Pages have a kind ('knowledge' or 'document') and may point to a canonical page.
Links (edge, source, target, type, proposed) have anchors (edge, page, block): the
places in pages that a link rests on. A plan names pages and places to read; it
decides nothing about what they say.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.operators.pools import choose
from lodestone.operators.sequences import numbered
from lodestone.session import materialise

# Types of links that are followed from their source, and from their target.
FORWARD = ("CITES", "REQUIRES", "DEPENDS_ON", "APPLIES_TO", "EXCEPTION_OF", "CONFLICTS_WITH", "SUPERSEDES", "PRECEDES", "PART_OF")
REVERSE = ("EXCEPTION_OF", "CONFLICTS_WITH", "SUPERSEDES", "PRECEDES")
#: Pages citing one place, at most, for the place to tell which of them is meant.
FANOUT = 2
#: Rows that are broadcast to meet the links, at most.
SMALL = 100_000


def _footprints(pages: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """page, item: what a knowledge page rests on (places of documents it cites) and what it is linked to otherwise."""
    wikis = pages.where("kind = 'knowledge'").select("page")
    real = edges.where("not proposed")
    cites = real.where("type = 'CITES'").join(pages.where("kind <> 'knowledge'").select(F.col("page").alias("target")), "target")
    at = cites.join(anchors.select("edge", F.col("page").alias("target"), "block"), ["edge", "target"], "left")
    evidence = at.select(F.col("source").alias("page"), F.concat_ws("|", F.lit("at"), F.col("target").cast("string"), F.coalesce(F.col("block").cast("string"), F.lit(""))).alias("item"))
    other = real.where(F.col("type").isin(*FORWARD, *REVERSE) & (F.col("type") != "CITES"))
    ends = [other.select(F.col(a).alias("page"), F.concat_ws("|", "type", F.lit(a), F.col(b).cast("string")).alias("item")) for a, b in (("source", "target"), ("target", "source"))]
    return evidence.unionByName(ends[0]).unionByName(ends[1]).join(wikis, "page", "left_semi").distinct()


def choose_seeds(units: list[dict], searches: dict[str, list[str]], most: int) -> list[tuple[str, bool]]:
    """(unit, whether a search's best) to start from, of one question.

    units in the order of rank: unit, page, section, blocks, knowledge, items,
    reranked; searches: units by rank. Each search's best comes first, then units
    of new sections, reranked ones first, then further ones. A knowledge page is read
    whole, so it comes once, and only if it brings an item (or is a search's best);
    a document's unit comes if it brings a block.
    """
    by_id = {u["unit"]: u for u in units}
    chosen: dict[str, bool] = {}
    pages: dict[str, set] = defaultdict(set)
    items: set = set()

    def add(u: dict, best: bool) -> None:
        wiki = u["knowledge"]
        if wiki and (u["page"] in pages or not best and u["items"] and set(u["items"]) <= items) or not wiki and set(u["blocks"]) <= pages.get(u["page"], set()):
            return
        if len(chosen) < most:
            chosen[u["unit"]] = best
            pages[u["page"]] |= set(u["blocks"])
            items.update(u["items"] if wiki else ())

    for found in searches.values():
        if known := [n for n in found if n in by_id]:
            add(by_id[known[0]], True)
    for reranked in (True, False):
        for fresh in (True, False):
            for u in units:
                seen = {(by_id[c]["page"], by_id[c]["section"]) for c in chosen} if fresh else ()
                if u["reranked"] == reranked and u["unit"] not in chosen and (u["page"], u["section"]) not in seen:
                    add(u, False)
    return list(chosen.items())


def unit_seeds(units: DataFrame, searches: DataFrame, pages: DataFrame, edges: DataFrame, anchors: DataFrame, most: int = 24) -> DataFrame:
    """query_id, page, unit, place, best, blocks: at most `most` units to start from, for every question.

    units: query_id, unit, page, section, blocks, score, rerank (null if not
    reranked); searches: query_id, search, unit, rank. A question's candidates meet
    in one task, with what their pages rest on: they are the ranked pool of one question.
    """
    prints = _footprints(pages, edges, anchors).groupBy("page").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = units.join(pages.select("page", "kind"), "page").join(prints, "page", "left")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").isNull(), F.coalesce("rerank", "score").desc(), "unit")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    best = searches.groupBy("query_id", "unit").agg(F.collect_list(F.struct("search", "rank")).alias("found"))
    rows = rows.join(best, ["query_id", "unit"], "left")
    page, unit = (rows.schema[c].dataType.simpleString() for c in ("page", "unit"))

    def pick(pool: list[dict]) -> Iterator[tuple]:
        listed = [dict(unit=r["unit"], page=r["page"], section=r["section"], blocks=r["blocks"], knowledge=r["kind"] == "knowledge", items=r["items"], reranked=r["rerank"] is not None) for r in pool]
        by: dict[str, list] = {}
        for _, search, unit in sorted((f["rank"], f["search"], r["unit"]) for r in pool for f in r["found"] or ()):
            by.setdefault(search, []).append(unit)
        page_of = {u["unit"]: (u["page"], u["blocks"]) for u in listed}
        for n, (u, best) in enumerate(choose_seeds(listed, {s: by[s] for s in sorted(by)}, most)):
            yield page_of[u][0], u, n, best, page_of[u][1]

    pools = rows.select("query_id", "unit", "page", "section", "blocks", "kind", "items", F.nanvl(F.col("rerank").cast("double"), F.lit(None)).alias("rerank"), "found", "at")
    return choose(pools, "query_id", [F.col("at")], pick, f"page {page}, unit {unit}, place int, best boolean, blocks array<string>")


def relevance_seeds(candidates: DataFrame, terms: DataFrame, most: int = 8, gain: float = 0.06) -> DataFrame:
    """query_id, page, place, reason: pages to start from by what they add to a question.

    candidates: query_id, page, role, relevance, hit, channels, strong, terms (the
    question's subject terms that the page matches); terms: query_id, term, mass.
    In each round the page of highest read_priority is taken for every question, as
    long as one adds a role or, being strong, a share `gain` of the terms' mass;
    beyond `most` rounds a page's reason is COVERAGE_ESCALATION. If no page of a
    question is strong all its pages may be taken, for review. As each round adds a
    role or that share, there are at most 1 / gain rounds and one for each role.
    """
    from lodestone.operators.structure import read_priority

    total = terms.groupBy("query_id").agg(F.greatest(F.sum("mass"), F.lit(1e-12)).alias("total"))
    weights = terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "mass"))).alias("masses"))
    of = Window.partitionBy("query_id")
    rows = candidates.withColumn("weak", ~F.max("strong").over(of)).where("strong or weak")
    rows = rows.withColumns({c: F.col(c) / F.greatest(F.max(c).over(of), F.lit(1e-12)) for c in ("relevance", "hit")})
    rows = materialise(rows.join(total, "query_id").join(weights, "query_id"), "candidates")
    none = F.array().cast("array<string>")
    taken = None
    for place in range(1 << 30):  # ends once no page of any question adds something
        if taken is None:
            state = rows.select("query_id").distinct().select("query_id", none.alias("covered"), none.alias("roles"))
        else:
            state = taken.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("covered"), F.collect_set("role").alias("roles"))
            left = rows.join(taken.select("query_id", "page"), ["query_id", "page"], "left_anti")
        now = (rows if taken is None else left).join(state, "query_id")
        new = F.aggregate(F.array_except("terms", "covered"), F.lit(0.0), lambda n, t: n + F.coalesce(F.element_at("masses", t), F.lit(0.0))) / F.col("total")
        role = F.col("role")
        fresh = ~F.array_contains("roles", role)
        needed = fresh & ((role == "wiki") | (role == "procedure_reference") | (F.size(F.array_except("roles", F.array(F.lit("wiki")))) == 0))
        useful = now.withColumn("gain", new).where((F.size("roles") == 0) | needed | (F.col("strong") & (F.col("gain") >= gain)))
        score = read_priority(F.col("relevance"), F.col("hit"), F.least(F.lit(2), "channels"), F.col("gain"), fresh.cast("int"))
        best = Window.partitionBy("query_id").orderBy(F.round(score, 12).desc(), "page")
        picked = useful.withColumn("first", F.row_number().over(best)).where("first = 1")
        reason = F.when(F.lit(place >= most), "COVERAGE_ESCALATION").when(F.col("weak"), "LOW_RELEVANCE").when(F.col("hit") > 0, "HYBRID_SEED").otherwise("CATALOG_RELEVANCE_SEED")
        picked = materialise(picked.select("query_id", "page", "role", "terms", F.lit(place).alias("place"), reason.alias("reason")), "picked")
        if picked.isEmpty():
            break
        taken = picked if taken is None else taken.unionByName(picked)
    empty = rows.where("false").select("query_id", "page", F.lit(0).alias("place"), F.lit("").alias("reason"))
    return empty if taken is None else taken.select("query_id", "page", "place", "reason")


def _cited(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """edge, source, target, places, block: places of pages that knowledge pages cite."""
    wiki = pages.where("kind = 'knowledge'").select(F.col("page").alias("source"))
    rows = edges.where("type = 'CITES' and not proposed").join(wiki, "source", "left_semi").select("edge", "source", "target", "places", F.explode("places").alias("at"))
    return rows.where("at.page = target").select("edge", "source", "target", "places", "at.block")


def _slots(query_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, slot, bit; and by slot its questions (bit, query_id): 64 questions share a slot, so one row tells which of them reach a page."""
    asked = numbered(query_ids.where("query_id is not null").distinct(), "n", "query_id")
    at = (F.col("n") - 1) % 64
    asked = materialise(asked.select("query_id", F.floor((F.col("n") - 1) / 64).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")).alias("bit")), "slots")
    by_slot = asked.groupBy("slot").agg(F.collect_list(F.struct("bit", "query_id")).alias("asked"))
    return _hinted(asked, asked), _hinted(by_slot, asked)


def _hinted(rows: DataFrame, size: DataFrame) -> DataFrame:
    """rows, to be broadcast if those of `size` (written ones, so that counting them is cheap) are at most SMALL."""
    return F.broadcast(rows) if size.limit(SMALL + 1).count() <= SMALL else rows


def _either(rows: DataFrame, *by: str) -> DataFrame:
    """One row per key with the questions (bits) of all its rows."""
    return rows.groupBy(*by).agg(F.bit_or("bits").alias("bits"))


def _both(rows: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """Rows for the questions that `other` has under the same key and slot (a row each)."""
    found = rows.join(other.withColumnRenamed("bits", "other_bits"), [*by, "slot"])
    return found.withColumn("bits", F.col("bits").bitwiseAND(F.col("other_bits"))).drop("other_bits").where("bits <> 0")


def _without(rows: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Rows for the questions that `known` doesn't have under the same key and slot (a row each)."""
    found = rows.join(known.withColumnRenamed("bits", "known_bits"), [*by, "slot"], "left")
    return found.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known_bits", F.lit(0).cast("long"))))).drop("known_bits").where("bits <> 0")


def expand(seeds: DataFrame, pages: DataFrame, edges: DataFrame, anchors: DataFrame, eligible: DataFrame, selective: bool = False, fanout: int = FANOUT, spelled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Reads (query_id, page, round, reasons, blocks) and used links (query_id, edge, page, reason) of every question.

    From read pages, round by round until nothing is new: their canonical pages; links of the
    FORWARD types; incoming ones of the REVERSE types; incoming citations by a
    knowledge page that rest on a block that the seeds (query_id, page, blocks) hold
    themselves. Blocks gathered on the way unlock nothing, so a manual that many
    pages cite does not bring them all in. Of such citing pages one comes in if it
    brings something that those read before and those ranked before it (eligible:
    query_id, page, rank, strong; ties and unranked ones by page) don't bring;
    with `selective` instead if at most `fanout` pages cite the block, or it is strong. Proposed
    links are followed to eligible pages only and mark what they lead to. The
    anchors of a used link are read too.

    Rounds carry one row for the questions of a slot, not one for each. Unless links are
    `spelled` they come as (edge, page, reason, queries), a row for each slot.
    """
    canonical = F.col("canonical") if "canonical" in pages.columns else F.lit(None).cast(pages.schema["page"].dataType)
    pages = materialise(pages.select("page", "kind", canonical.alias("canonical")), "pages")
    edges = edges.where(F.col("type").isin(*FORWARD, *REVERSE)).join(pages.select(F.col("page").alias("source")), "source", "left_semi").join(pages.select(F.col("page").alias("target")), "target", "left_semi")
    edges = materialise(edges.select("edge", "source", "target", "type", "proposed"), "edges")
    anchors = anchors.join(edges.select("edge"), "edge", "left_semi").join(pages.select("page"), "page", "left_semi")
    places = anchors.groupBy("edge").agg(F.collect_set(F.struct("page", "block")).alias("places"))
    edges = materialise(edges.join(places, "edge", "left"), "placed")
    seeds = materialise(seeds.select("query_id", "page", "blocks"), "seeds")
    asked, by_slot = _slots(seeds.select("query_id"))
    eligible = materialise(eligible.select("query_id", "page", "rank", "strong"), "eligible")
    able = materialise(_either(eligible.join(asked, "query_id").select("page", "slot", F.col("bit").alias("bits")), "page", "slot"), "able")
    prints = None if selective else materialise(_footprints(pages, edges, edges.select("edge", F.explode("places").alias("p")).select("edge", "p.page", "p.block")), "footprints")
    held = seeds.select("query_id", F.col("page").alias("target"), F.explode("blocks").alias("block")).distinct()
    cited = _cited(edges, pages).join(held.select("target", "block").distinct(), ["target", "block"], "left_semi")
    at = held.join(cited, ["target", "block"])
    if selective:
        shared = cited.groupBy("target", "block").agg(F.countDistinct("source").alias("sources"))
        at = at.join(shared, ["target", "block"]).join(eligible.select("query_id", F.col("page").alias("source"), "strong"), ["query_id", "source"], "left")
        at = at.where(F.coalesce("strong", F.lit(False)) | (F.col("sources") <= fanout))
    back = _either(at.join(asked, "query_id").select("edge", "source", "target", "places", "slot", F.col("bit").alias("bits")), "edge", "source", "target", "places", "slot")
    back = materialise(back, "citing")

    begun = seeds.join(asked, "query_id").select("page", "slot", F.col("bit").alias("bits"), "blocks")
    front = materialise(_either(begun, "page", "slot").withColumn("round", F.lit(0)), "read")
    known, used = front, []
    for step in range(1, 1 << 30):
        near = _hinted(front.select("page", "slot", "bits"), front)
        out = near.join(edges, near["page"] == edges["source"]).select("edge", F.col("target").alias("page"), "proposed", F.when(F.col("type") == "CITES", "CITES_SOURCE").otherwise(F.concat("type", F.lit("_CONTEXT"))).alias("reason"), "places", "slot", "bits")
        into = near.join(edges.where(F.col("type").isin(*REVERSE)), near["page"] == edges["target"]).select("edge", F.col("source").alias("page"), "proposed", F.concat(F.lit("INCOMING_"), "type").alias("reason"), "places", "slot", "bits")
        both = out.unionByName(into)
        firm = both.where(~F.col("proposed")).drop("proposed")
        loose = _both(both.where(F.coalesce("proposed", F.lit(True))), able, "page").withColumn("reason", F.when(F.col("proposed"), "PROPOSED_NAVIGATION").otherwise(F.col("reason"))).drop("proposed")
        citing = _both(back, front.select(F.col("page").alias("target"), "slot", "bits"), "target").select("edge", F.col("source").alias("page"), "places", "slot", "bits")
        if not selective:
            citing = _new_only(materialise(citing, "citing"), known, prints, eligible, asked, by_slot)
        same = near.join(pages.where("canonical is not null"), "page").select(F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"), F.col("canonical").alias("page"), F.lit("CANONICAL_NAVIGATION").alias("reason"), F.lit(None).cast(edges.schema["places"].dataType).alias("places"), "slot", "bits").join(pages.select("page"), "page", "left_semi")
        links = materialise(firm.unionByName(loose).unionByName(citing.withColumn("reason", F.lit("REVERSE_CITES_EXACT"))).unionByName(same), "used")
        used.append(links)
        ends = links.select("page", "slot", "bits").unionByName(links.select(F.explode("places.page").alias("page"), "slot", "bits"))
        ahead = _without(_either(ends, "page", "slot"), _either(known, "page", "slot"), "page")
        front = materialise(ahead.withColumn("round", F.lit(step)), "read")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    links = used[0]
    for more in used[1:]:
        links = links.unionByName(more)
    none = F.lit(None).cast("string")
    resting = links.select(F.explode("places").alias("at"), "reason", "slot", "bits").select("at.page", F.col("at.block").cast("string").alias("block"), F.when(F.col("reason") == "PROPOSED_NAVIGATION", "PROPOSED_ANCHOR_NAVIGATION").otherwise("RELATION_SOURCE_ANCHOR").alias("reason"), "slot", "bits")
    facts = [
        links.select("page", "slot", "bits", "reason", none.alias("block")), resting.select("page", "slot", "bits", "reason", "block"),
        begun.select("page", "slot", "bits", F.lit("SEED").alias("reason"), F.explode_outer("blocks").alias("block")),
    ]
    told = facts[0].unionByName(facts[1]).unionByName(facts[2]).withColumn("round", F.lit(None).cast("int")).unionByName(known.select("page", "slot", "bits", none.alias("reason"), none.alias("block"), "round"))
    # One row for a page and slot, then one for each of its questions.
    each = _either(told, "page", "slot", "reason", "block", "round").groupBy("page", "slot").agg(*(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "bits"))).alias(c) for c in ("reason", "block", "round")))
    rows = each.join(by_slot, "slot").select("page", "reason", "block", "round", F.explode("asked").alias("q"))
    mine = lambda c: F.transform(F.filter(c, lambda x: x["bits"].bitwiseAND(F.col("q.bit")) != 0), lambda x: x[c])
    reads = rows.withColumn("r", mine("round")).where(F.size("r") > 0)
    reads = reads.select("q.query_id", "page", F.array_min("r").alias("round"), F.array_sort(F.array_distinct(mine("reason"))).alias("reasons"), F.array_sort(F.array_distinct(mine("block"))).alias("blocks"))
    links = _either(links, "edge", "page", "reason", "slot").join(by_slot, "slot")
    links = links.select("edge", "page", "reason", F.transform(F.filter("asked", lambda q: q["bit"].bitwiseAND(F.col("bits")) != 0), lambda q: q["query_id"]).alias("queries"))
    return reads, links.select(F.explode("queries").alias("query_id"), "edge", "page", "reason") if spelled else links


def _new_only(citing: DataFrame, known: DataFrame, prints: DataFrame, eligible: DataFrame, asked: DataFrame, by_slot: DataFrame) -> DataFrame:
    """Citing pages that were read already, rest on nothing, or bring an item first, in their order.

    A page that brings none adds none to those before it, so an item's first bearer
    is the same whether such pages count or not. Of what read pages rest on only the
    items of citing pages are looked up.
    """
    pages = _either(citing, "page", "slot")
    read = _both(pages, _either(known.join(pages.select("page").distinct(), "page", "left_semi"), "page", "slot"), "page")
    bare = pages.join(prints, "page", "left_anti")
    items = pages.join(prints, "page")
    seen = prints.join(items.select("item").distinct(), "item", "left_semi").join(known.select("page", "slot", "bits"), "page")
    fresh = _without(items, _either(seen, "item", "slot"), "item").join(by_slot, "slot").select("page", "item", "bits", F.explode("asked").alias("q")).where(F.col("bits").bitwiseAND(F.col("q.bit")) != 0)
    fresh = fresh.select("q.query_id", "page", "item").join(eligible.select("query_id", "page", "rank"), ["query_id", "page"], "left")
    first = fresh.groupBy("query_id", "item").agg(F.min(F.struct(F.col("rank").isNull().alias("unranked"), "rank", "page")).alias("first"))
    first = first.select("query_id", "first.page").distinct().join(asked, "query_id").select("page", "slot", F.col("bit").alias("bits"))
    good = _either(read.select("page", "slot", "bits").unionByName(bare.select("page", "slot", "bits")).unionByName(first), "page", "slot")
    return _both(citing, good, "page").select("edge", "page", "places", "slot", "bits")


def plan_warnings(queries: DataFrame, reads: DataFrame, links: DataFrame, pages: DataFrame, edges: DataFrame, seeds: DataFrame, searches: DataFrame) -> DataFrame:
    """query_id, warnings, counts of what is read: sources, wikis, by links, of searches without their best.

    links as expand() gives them, spelled or not.
    """
    kinds = reads.join(pages.select("page", "kind"), "page").withColumn("wiki", F.col("kind") == "knowledge")
    cites = links.join(edges.where("type = 'CITES' and not proposed").select("edge", "source", "target"), "edge").join(pages.where("kind <> 'knowledge'").select(F.col("page").alias("target")), "target", "left_semi")
    if "queries" in links.columns:
        cites = cites.select("source", "queries").distinct().withColumn("query_id", F.explode("queries"))
    backed = cites.select("query_id", F.col("source").alias("page"), F.lit(True).alias("backed")).distinct()
    per = kinds.join(backed, ["query_id", "page"], "left").groupBy("query_id").agg(
        F.count_if("wiki").alias("wikis"), F.count_if(~F.col("wiki")).alias("sources"), F.count_if(F.col("round") > 0).alias("by_links"),
        F.count_if(F.col("wiki") & F.col("backed").isNull()).alias("unbacked"), F.count_if(~F.col("wiki") & (F.size("blocks") == 0)).alias("unplaced"), F.bool_or(F.array_contains("reasons", "PROPOSED_NAVIGATION")).alias("proposed"),
    )
    heads = searches.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "search").orderBy("rank", "unit"))).where("first = 1")
    missed = heads.join(seeds.select("query_id", "unit"), ["query_id", "unit"], "left_anti").groupBy("query_id").agg(F.count("*").alias("missed"))
    rows = queries.select("query_id").join(per, "query_id", "left").join(missed, "query_id", "left").fillna(0).fillna(False)
    codes: dict[str, Column] = {
        "DOCUMENT_ONLY_COVERAGE_RISK": (F.col("sources") > 0) & (F.col("wikis") == 0), "NO_READ_CANDIDATES": F.col("sources") + F.col("wikis") == 0, "PROPOSED_RELATIONS_NAVIGATION_ONLY": F.col("proposed"),
        "QUERY_CANDIDATES_DEFERRED": F.col("missed") > 0, "SINGLE_DOCUMENT_COVERAGE_RISK": F.col("sources") == 1, "SOURCE_ANCHORS_MISSING": F.col("unplaced") > 0, "WIKI_SOURCE_CHAIN_MISSING": F.col("unbacked") > 0,
    }
    named = F.array_compact(F.array(*(F.when(on, F.lit(code)) for code, on in codes.items())))
    return rows.select("query_id", named.alias("warnings"), "sources", "wikis", "by_links", "missed")

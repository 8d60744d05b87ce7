"""Answer contexts: what a question asks for, whole paragraphs of sources, and a cover of its facets under a budget."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.functions import answers as P
from lodestone.operators.pools import choose

#: Terms of a vocabulary that are broadcast, at most.
VOCABULARY = 10_000


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def question_plan(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, intent, assets, events, special, dimensions, requirements (struct<dimension, facets>), roles, assumed.

    questions: query_id, question (with its context). vocabulary: kind (asset,
    event, special), name, term; a name is asked for if one of its terms is in the question,
    whatever the case; special terms name themselves. A question that names an event and no
    task is taken to ask for its valuation (assumed).
    """
    if vocabulary.limit(VOCABULARY + 1).count() > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} terms")
    words = vocabulary.agg(F.sort_array(F.collect_set(F.struct("kind", "name", F.lower("term").alias("low"), "term"))).alias("words"))
    text = F.coalesce("question", F.lit(""))
    has = lambda pattern: text.rlike(pattern)
    rows = questions.crossJoin(F.broadcast(words)).withColumn("hits", F.filter("words", lambda w: F.contains(F.lower(text), w["low"])))
    named = lambda kind: F.array_distinct(F.transform(F.filter("hits", lambda w: w["kind"] == kind), lambda w: w["name"]))
    rows = rows.withColumns({"events": named("event"), "assets": named("asset"), "special": F.array_union(named("special"), F.array_distinct(F.transform(F.filter("hits", lambda w: (w["kind"] == "event") & F.contains(text, w["term"])), lambda w: w["term"])))})
    event = lambda name: F.array_contains("events", name)
    rows = rows.withColumn("assets", F.when(event("bond_put") & (F.size("assets") == 0), _strings("债券")).otherwise(F.col("assets")))
    any_event, purchase, posting, validity = F.size("events") > 0, has(P.PURCHASE), has(P.POSTING), has(P.VALIDITY)
    exchange = has(P.EXCHANGE) & ~has(P.VALUATION)
    rows = rows.withColumn("assumed", any_event & ~has(P.VALUATION) & ~posting & ~exchange & ~validity)
    valuation = has(P.VALUATION) | F.col("assumed")
    intent = F.when(exchange, "exchange_rules").when(validity & ~posting & ~purchase, "rule_validity").when(any_event & valuation, "specialist_valuation")
    intent = intent.when(posting | (purchase & (F.size("assets") > 0)), "fund_accounting_practice").when((F.size("special") > 0) & (valuation | has(P.MODEL)), "special_case").otherwise("general_knowledge")
    rows = rows.withColumn("routed", intent)
    routed = F.col("routed")

    need = lambda on, dimension, *facets: F.when(on, F.array(F.struct(F.lit(dimension).alias("dimension"), _strings(*facets).alias("facets")))).otherwise(F.array().cast("array<struct<dimension: string, facets: array<string>>>"))
    trading, special = exchange & any_event, any_event & (routed == "specialist_valuation")
    interrupted = F.arrays_overlap("events", _strings(*P.INTERRUPTIONS))
    quoted = ("valuation_method", "no_quote", "quote_reliability", "inactive_market", "material_impact")
    needs = F.concat(
        need(trading | special, "applicability", "scope"), need(trading, "trading_procedure", "trading_procedure"), need(special & interrupted & has(P.INAPPLICABLE), "inapplicability", "exclusion"),
        need(special & interrupted, "subsequent_measurement", *quoted), need(special & ~interrupted, "subsequent_measurement", "valuation_method"),
        need(special & event("bond_put"), "exercise_state", "exercise_state"), need(special & event("bond_put"), "quote_selection", "quote_options", "quote_conditions"),
        need(special, "governance", *P.GOVERNANCE), need(special & posting, "accounting_entries", "accounting_entries"),
    )
    plain = F.array_compact(F.array(F.when(purchase, "initial_measurement"), F.when(valuation, "subsequent_measurement"), F.when(posting, "accounting_entries")))
    dimensions = F.when(trading | special, F.transform("requirements", lambda n: n["dimension"])).when(F.size(plain) > 0, plain).otherwise(_strings("topic_explanation"))
    roles = F.lit(None).cast("array<string>")
    for name, of in P.ROLES.items():
        roles = F.when(routed == name, _strings(*of)).otherwise(roles)
    rows = rows.withColumn("requirements", needs).withColumn("dimensions", dimensions)
    return rows.select("query_id", F.when(routed == "special_case", "specialist_valuation").otherwise(routed).alias("intent"), "assets", "events", "special", "dimensions", "requirements", roles.alias("roles"), "assumed")


def paragraphs(blocks: DataFrame) -> DataFrame:
    """version_id, first_ordinal, block_ids, text, n_bytes, complete, detail_gap: whole paragraphs of sources, put together from their lines.

    blocks: version_id, block_id, ordinal, kind, text, heading, section, page (null:
    none). A gap between ordinals, a heading, a contents line, a numbered clause and a table, list or
    formula begin a paragraph; an end of a sentence closes one. A number alone is
    no paragraph; at the end of a page it is the page's number. What follows an article in its section without a
    clause of its own belongs to it. A paragraph is complete if its sentence ends.
    Where lines without CJK letters break a section up, and after a colon, details
    are missing; a paragraph that branches there is not complete.
    """
    order = Window.partitionBy("version_id").orderBy("ordinal", "block_id")
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "^【原件[^】]*】\\s*", ""))
    special = F.col("kind").isin("table", "list", "formula")
    rows = blocks.withColumn("body", body)
    number = F.col("body").rlike("^\\d+$")
    rows = rows.withColumns({
        "adjacent": F.coalesce(F.lag("ordinal").over(order) + 1 == F.col("ordinal"), F.lit(False)),
        "footer": number & (F.col("page").cast("string") == F.col("body")) & (F.lead("page").over(order) != F.col("page")),
        "out": F.coalesce(F.col("heading"), F.lit(False)) | (F.col("body") == "") | F.col("body").rlike(P.CONTENTS), "special": special,
    })
    rows = rows.withColumn("out", F.col("out") | F.coalesce("footer", F.lit(False))).withColumn("ends", F.col("out") | F.col("special") | F.col("body").rlike(P.SENTENCE_END))
    opens = ~F.col("adjacent") | F.col("out") | F.coalesce(F.lag("ends").over(order), F.lit(True)) | F.col("body").rlike(P.CLAUSE) | F.col("special")
    rows = rows.withColumn("part", F.sum(opens.cast("int")).over(order)).where("not out")
    # Numbers in front of a paragraph's first line of another kind are left out.
    inside = Window.partitionBy("version_id", "part").orderBy("ordinal", "block_id")
    rows = rows.withColumn("said", F.max((~F.col("body").rlike("^\\d+$")).cast("int")).over(inside)).where("said = 1")
    lines = F.struct("ordinal", "block_id", "body", "text", "special", (F.coalesce("kind", F.lit("")).eqNullSafe("paragraph") & ~F.col("body").rlike("[㐀-鿿]")).alias("odd"))
    units = rows.groupBy("version_id", "part").agg(F.sort_array(F.collect_list(lines)).alias("lines"), F.min_by("section", F.struct("ordinal", "block_id")).alias("section"), F.min_by("adjacent", F.struct("ordinal", "block_id")).alias("adjacent"))
    joined = F.array_join(F.transform("lines", lambda x: x["body"]), "")
    units = units.withColumn("text", joined)
    whole = F.col("text").rlike(P.SENTENCE_END) | F.col("text").rlike("[：:]$") | F.forall("lines", lambda x: x["special"])
    units = units.withColumn("whole", whole).withColumn("odd", F.exists("lines", lambda x: x["odd"]))

    by = Window.partitionBy("version_id").orderBy("part")
    last = F.lag(F.element_at("lines", -1)["ordinal"]).over(by)
    follows = ~F.col("text").rlike(P.CLAUSE) & F.coalesce(F.lag("section").over(by).eqNullSafe(F.col("section")), F.lit(False)) & F.coalesce(last + 1 == F.element_at("lines", 1)["ordinal"], F.lit(False))
    units = units.withColumn("chain", F.sum((~follows).cast("int")).over(by))
    head = F.first("text").over(Window.partitionBy("version_id", "chain").orderBy("part"))
    units = units.withColumn("of", F.when(head.rlike(P.ARTICLE), F.struct("chain", F.lit(-1).alias("part"))).otherwise(F.struct("chain", "part")))
    merged = units.groupBy("version_id", "of").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "lines"))), lambda x: x["lines"])).alias("lines"), F.bool_and("whole").alias("whole"), F.bool_or("odd").alias("odd"), F.min_by("section", "part").alias("section"))
    merged = merged.withColumn("text", joined).withColumn("broken", F.bool_or("odd").over(Window.partitionBy("version_id", "section")))
    merged = merged.withColumn("detail_gap", F.col("broken") | F.col("text").rlike("[：:]$"))
    complete = F.col("whole") & ~F.col("odd") & ~(F.col("detail_gap") & F.col("text").rlike(P.BRANCH))
    size = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["text"]))
    return merged.select("version_id", F.element_at("lines", 1)["ordinal"].alias("first_ordinal"), F.transform("lines", lambda x: x["block_id"]).alias("block_ids"), "text", size.alias("n_bytes"), complete.alias("complete"), "detail_gap")


def facets(text: Column) -> Column:
    """Facets that a passage shows, in their fixed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in P.FACETS.items())))


def cover(items: list[dict], related: list[dict], required: set[str], primary: object, limit: int, max_bytes: int) -> tuple[list[tuple[int, str]], list[int]]:
    """(item, role) in the order they are taken, and items left out for the budget, of one question.

    The item of most new facets comes first; ties go to the primary version,
    exclusions, direct hits, few blocks, early places. Items without a new facet come
    from the primary version only. An item is taken whole or not at all. At last come
    up to three related ones, in their order, that cite a block taken.
    """
    taken: list[tuple[int, str]] = []
    left_out: list[int] = []
    covered: set[str] = set()
    blocks: set = set()
    n = used = 0
    rest = dict(enumerate(items))
    while rest:
        at = max(rest, key=lambda i: (len((rest[i]["facets"] & required) - covered), rest[i]["version"] == primary, rest[i]["exclusion"], rest[i]["direct"], -len(rest[i]["blocks"]), -rest[i]["ordinal"], -i))
        item = rest.pop(at)
        new = (item["facets"] & required) - covered
        if not new and item["version"] != primary:
            continue
        if n + len(item["blocks"]) > limit or used + item["bytes"] > max_bytes:
            left_out.append(at)
            continue
        taken.append((at, "primary" if item["version"] == primary else "supporting"))
        n, used = n + len(item["blocks"]), used + item["bytes"]
        covered |= new
        blocks |= {(item["version"], b) for b in item["blocks"]}
    linked = 0
    for i, item in enumerate(related, len(items)):
        if linked < 3 and n < limit and used + item["bytes"] <= max_bytes and item["cites"] & blocks:
            taken.append((i, "related_knowledge"))
            n, used, linked = n + 1, used + item["bytes"], linked + 1
    return taken, left_out


def answer_context(plans: DataFrame, units: DataFrame, related: DataFrame, limit: int = 28, max_bytes: int = 14_000) -> DataFrame:
    """query_id, place, role (null: left out), version_id, first_ordinal, block_ids, facets, primary_version: the passages that a question's answer is given.

    plans: query_id, requirements. units: query_id, version_id, title,
    first_ordinal, block_ids, facets, n_bytes, complete, exclusion, direct. related
    (knowledge pages): query_id, version_id, block_id, n_bytes, cites (struct<version_id,
    block_id>), score. The primary version is the one that isn't historical, shows most
    required facets and most direct hits; only complete units that aren't exclusions count for that.
    A question's passages meet in one task: they are the ranked pool of one question.
    """
    needs = plans.select("query_id", F.array_distinct(F.flatten(F.transform("requirements", lambda n: n["facets"]))).alias("required"))
    rows = units.where("complete").join(needs, "query_id")
    counted = rows.where("not exclusion").groupBy("query_id", "version_id").agg(
        (~F.coalesce(F.max("title"), F.lit("")).rlike(P.HISTORICAL)).alias("current"), F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list("facets"))), F.first("required"))).alias("shown"), F.count_if("direct").alias("hits"), F.max("title").alias("title"),
    )
    best = counted.groupBy("query_id").agg(F.max_by("version_id", F.struct("current", "shown", "hits", "title", "version_id")).alias("primary_version"))
    rows = rows.join(best, "query_id", "left").withColumn("score", F.lit(0.0)).withColumn("cites", F.lit(None).cast("array<struct<version_id: string, block_id: string>>"))
    more = related.select("query_id", "version_id", F.array("block_id").alias("block_ids"), "n_bytes", "cites", "score").withColumn("knows", F.lit(True))
    both = rows.withColumn("knows", F.lit(False)).unionByName(more, allowMissingColumns=True)

    def pick(pool: list[dict]) -> Iterator[tuple]:
        mine = [r for r in pool if not r["knows"]]
        if not mine:
            return
        items = [dict(version=r["version_id"], facets=set(r["facets"]), exclusion=bool(r["exclusion"]), direct=bool(r["direct"]), blocks=r["block_ids"], ordinal=r["first_ordinal"], bytes=r["n_bytes"]) for r in mine]
        known = [dict(version=r["version_id"], blocks=r["block_ids"], bytes=r["n_bytes"], cites={(c["version_id"], c["block_id"]) for c in r["cites"] or ()}) for r in pool if r["knows"]]
        primary, every = mine[0]["primary_version"], items + known
        taken, left_out = cover(items, known, set(mine[0]["required"]), primary, limit, max_bytes)
        for n, (i, role) in enumerate([*taken, *((i, None) for i in left_out)]):
            yield n, role, every[i]["version"], every[i].get("ordinal"), every[i]["blocks"], sorted(every[i].get("facets", ())), primary

    order = [F.col("knows"), F.col("score").desc_nulls_last(), "version_id", "first_ordinal"]
    return choose(both, "query_id", order, pick, "place int, role string, version_id string, first_ordinal int, block_ids array<string>, facets array<string>, primary_version string")

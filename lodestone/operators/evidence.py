"""Evidence: fences, verified spans, rules, facts over time, reading plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.operators.sequences import numbered
from lodestone.session import materialise, spread

#: Pages of a class that travel together.
SLICE = 512


def fence(hits: DataFrame, catalog: DataFrame, *keys: str) -> DataFrame:
    """Hits whose identity and signature are those of the current catalogue."""
    return hits.join(catalog.select(*keys).distinct(), list(keys), "left_semi")


def verified_hits(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits (hit, block, start, end, content_sha256) all of whose spans fit their block; one bad span drops the hit.

    A span fits if its block exists with the same hash, and 0 <= start < end <= length.
    """
    rows = hits.join(blocks.select("block", F.col("content_sha256").alias("now"), F.col("length")), "block", "left")
    ok = F.coalesce((F.col("content_sha256") == F.col("now")) & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("length")), F.lit(False))
    return rows.groupBy("hit").agg(F.bool_and(ok).alias("ok"), F.count("*").alias("n_spans")).where("ok").select("hit", "n_spans")


def term_match(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose text contains any term of a stated set of at most 24 (column term); the terms are one array, so rows are never multiplied."""
    if terms.select("term").distinct().limit(25).count() > 24:
        raise ValueError("more than 24 terms")
    asked = terms.agg(F.collect_set("term").alias("terms"))
    return docs.crossJoin(F.broadcast(asked)).where(F.exists("terms", lambda t: F.contains(F.col(text), t))).select(key).distinct()


def rule_active(groups: Column, question: Column, start: Column, day: Column) -> Column:
    """Whether every group of terms has one in the question, and the rule has started."""
    return F.forall(groups, lambda g: F.exists(g, lambda t: F.contains(question, t))) & (start.isNull() | (start <= day))


def class_of(value: Column, classes: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first class whose pattern is found."""
    out = F.lit(otherwise)
    for pattern, name in reversed(classes):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def single_identity(rows: DataFrame, key: str, *signature: str) -> DataFrame:
    """Keys with exactly one signature; conflicting ones are dropped whole."""
    return rows.groupBy(key).agg(F.countDistinct(*signature).alias("n")).where("n = 1").select(key)


def closed_pairs(links: DataFrame, kept: DataFrame) -> DataFrame:
    """block, citations: links (block, cited) with both ends kept, as one sorted list per block."""
    ends = kept.select("block").distinct()
    rows = links.join(ends, "block", "left_semi").join(ends.withColumnRenamed("block", "cited"), "cited", "left_semi")
    return rows.groupBy("block").agg(F.sort_array(F.collect_set("cited")).alias("citations"))


def inbound_free(resources: DataFrame, links: DataFrame, purge: DataFrame) -> DataFrame:
    """Resources to purge that nothing outside the purge depends on."""
    outside = links.join(purge.withColumnRenamed("resource", "src"), "src", "left_anti")
    return purge.join(outside.select(F.col("dst").alias("resource")), "resource", "left_anti").join(resources, "resource", "left_semi")


def title_links(statements: DataFrame, titles: DataFrame) -> DataFrame:
    """statement, page: named titles resolved by their base; of several the one of the statement's year, else none if still several.

    statements: statement, base, year; titles: page, base, year. Titles are counted
    by base, and by base and year, so that no statement meets more than two rows.
    """
    by_base = titles.groupBy("base").agg(F.count("*").alias("n"), F.min("page").alias("only"))
    by_year = titles.groupBy("base", "year").agg(F.count("*").alias("same"), F.min("page").alias("dated"))
    rows = statements.join(by_base, "base").join(by_year, ["base", "year"], "left")
    page = F.when(F.col("n") == 1, F.col("only")).when(F.col("same") == 1, F.col("dated"))
    return rows.select("statement", page.alias("page")).where("page is not null")


def _classes(titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """page, class: pages of the same titles share a class; and class, n_pages, title, own, of_base, of_version, of_year: what its pages are called."""
    pages = titles.where("title <> ''").select("page", F.struct("title", "own", F.col("base").alias("of_base"), F.col("version").alias("of_version"), F.col("year").alias("of_year")).alias("t"))
    sets = materialise(pages.groupBy("page").agg(F.array_sort(F.collect_set("t")).alias("names")).withColumn("class", F.sha2(F.to_json("names"), 256)), "titles")
    return sets.select("page", "class"), sets.groupBy("class", "names").agg(F.count("*").alias("n_pages")).select("class", "n_pages", F.explode("names").alias("t")).select("class", "n_pages", "t.*")


def title_matches(named: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named titles with every page they may mean, by classes of pages: the columns of named, and class, n_pages, of_base, of_year; and the pages (page, class).

    named: full, base, version (its edition, null: none) and any other columns but
    those of titles. titles: page, title, own (the title without what publishes it),
    base, version, year. Bases under six characters match nothing, different
    editions never match, and a named edition matches an unversioned page only by
    the full title. Otherwise full titles or bases are equal, or the page's own title holds a
    base of ten characters or more: equal ones are joined, held ones looked up by an automaton.
    Each title is looked up once, whoever names it, and among classes: a page is in one only.
    """
    from lodestone.operators.curation import occurrences

    pages, classes = _classes(titles)
    classes = materialise(classes, "classes")
    fit = materialise(named.where(F.length("base") >= 6).select("full", "base", "version").distinct(), "named")
    long = fit.where(F.length("base") >= 10)
    held = occurrences(long.select(F.col("base").alias("name")), classes.select(F.col("own").alias("src"), F.col("own").alias("text")).distinct()).select(F.col("src").alias("own"), F.col("name").alias("base"))
    rows = fit.join(classes, F.col("full") == F.col("title")).unionByName(fit.join(classes, F.col("base") == F.col("of_base"))).unionByName(long.join(held, "base").join(classes, "own").select(*fit.columns, *classes.columns))
    apart = F.col("version").isNotNull() & (F.col("of_version").isNull() & (F.col("full") != F.col("title")) | (F.col("of_version") != F.col("version")))
    found = rows.where(~F.coalesce(apart, F.lit(False))).select("full", "base", F.col("version").alias("meant"), "class", "n_pages", "of_base", "of_year").distinct()
    same = (named["full"].eqNullSafe(found["full"])) & (named["base"] == found["base"]) & named["version"].eqNullSafe(found["meant"])
    return named.join(found, same).select(*(named[c] for c in named.columns), "class", "n_pages", "of_base", "of_year"), pages


def _spelled(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (class and others, distinct) with every page of their class; as a page is in one class, no pair comes twice.

    The pages of a class travel in slices of SLICE, dealt to all cores: pairs are
    spelled out where source and slice meet, and never shuffled.
    """
    place = F.row_number().over(Window.partitionBy("class").orderBy("page"))
    sliced = materialise(pages.withColumn("slice", F.floor((place - 1) / SLICE)).groupBy("class", "slice").agg(F.collect_list("page").alias("pages")), "slices")
    counts = sliced.groupBy("class").agg(F.max("slice").alias("last"))
    asked = rows.join(counts, "class").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    met = spread(asked, "class", "slice").join(spread(sliced, "class", "slice").hint("shuffle_hash"), ["class", "slice"])
    return met.drop("class", "slice").withColumn("page", F.explode("pages")).drop("pages")


def abolitions(named: DataFrame, titles: DataFrame) -> DataFrame:
    """source, page, partial: what a page (source, of a year) repeals, whole or in part; never itself or an edition dated after it."""
    rows, pages = title_matches(named, titles)
    rows = rows.where(~F.coalesce(F.col("of_year") > F.col("year"), F.lit(False))).select("source", "partial", "class").distinct()
    return _spelled(rows, pages).where("source <> page").select("source", "page", "partial")


def publications(named: DataFrame, titles: DataFrame) -> DataFrame:
    """source, page: what a page (source, own_base, year) publishes; of several editions those of its year, if there are any. Never its own base."""
    rows, pages = title_matches(named, titles)
    same = F.coalesce(F.col("of_year") == F.col("year"), F.lit(False))
    rows = rows.where("of_base <> own_base").withColumn("same", same).join(pages.select(F.col("page").alias("source"), F.col("class").alias("own_class")), "source", "left")
    rows = rows.withColumn("n_pages", F.col("n_pages") - (F.col("class").eqNullSafe(F.col("own_class"))).cast("int")).where("n_pages > 0")
    each = rows.groupBy("source", "full", "class").agg(F.max("n_pages").alias("n_pages"), F.bool_or("same").alias("same"))
    by = each.groupBy("source", "full").agg(F.sum("n_pages").alias("n"), F.bool_or("same").alias("dated"))
    taken = each.join(by, ["source", "full"]).where((F.col("n") == 1) | ~F.col("dated") | F.col("same")).select("source", "class").distinct()
    return _spelled(taken, pages).where("source <> page").select("source", "page")


def editions(titles: DataFrame) -> DataFrame:
    """page, next_page: each edition and the next newer one of the same base and kind of version key.

    titles: page, base, kind, version (array of numbers, ordered lexicographically).
    """
    w = Window.partitionBy("base", "kind").orderBy("version", "page")
    return titles.withColumn("next_page", F.lead("page").over(w)).where("next_page is not null").select("page", "next_page")


def facts_on(facts: DataFrame, pages: DataFrame, day: Column) -> DataFrame:
    """predecessor, state: what full replacement facts say on a day about a page.

    CONFLICT with more than one valid successor, REPLACED with one, else
    UNRESOLVED when the successor is unknown. facts: predecessor, successor,
    effective_from, state, scope; pages: page.
    """
    live = facts.where((F.col("state") == "CONFIRMED") & (F.col("scope") == "full") & (F.col("effective_from") <= day))
    known = pages.select(F.col("page").alias("successor"), F.lit(True).alias("known"))
    rows = live.join(known, "successor", "left").groupBy("predecessor").agg(F.countDistinct(F.when(F.col("known"), F.col("successor"))).alias("n"))
    return rows.select("predecessor", F.when(F.col("n") > 1, "CONFLICT").when(F.col("n") == 1, "REPLACED").otherwise("UNRESOLVED").alias("state"))


def bound(spans: DataFrame, manifest: DataFrame) -> DataFrame:
    """span, state: BOUND by all four keys, HASH_MISMATCH by the first three only, else MISSING."""
    keys = ["resource", "version", "block"]
    full = manifest.select(*keys, "sha", F.lit(True).alias("whole")).distinct()
    some = manifest.select(*keys, F.lit(True).alias("part")).distinct()
    rows = spans.join(full, [*keys, "sha"], "left").join(some, keys, "left")
    return rows.select("span", F.when(F.col("whole"), "BOUND").when(F.col("part"), "HASH_MISMATCH").otherwise("MISSING").alias("state"))


def size_stats(blocks: DataFrame, version: str, text: str) -> DataFrame:
    """version, n_blocks, n_chars."""
    return blocks.groupBy(version).agg(F.count("*").alias("n_blocks"), F.sum(F.length(text)).alias("n_chars"))


def index_state(receipts: DataFrame, by: str, wanted: Column) -> DataFrame:
    """Per index: SYNC_REQUIRED unless all its receipts are of the wanted generation, and when it was last indexed."""
    current = F.count(F.when(F.col("generation") == wanted, 1))
    return receipts.groupBy(by).agg(F.when(current == F.count("*"), "CURRENT").otherwise("SYNC_REQUIRED").alias("state"), current.alias("n_current"), F.max("indexed_at").alias("last_indexed"))


def batch_state(units: DataFrame, by: str) -> DataFrame:
    """Per batch the counts of unit states, COMPLETE if all units are done, else PARTIAL; the strongest state of a unit counts.

    Order of strength: DONE, FAILED, PENDING.
    """
    order = F.when(F.col("state") == "DONE", 0).when(F.col("state") == "FAILED", 1).otherwise(2)
    once = units.groupBy(by, "unit").agg(F.min(order).alias("s"))
    return once.groupBy(by).agg(
        F.count(F.when(F.col("s") == 0, 1)).alias("n_done"), F.count(F.when(F.col("s") == 1, 1)).alias("n_failed"), F.count(F.when(F.col("s") == 2, 1)).alias("n_pending"), F.when(F.max("s") == 0, "COMPLETE").otherwise("PARTIAL").alias("state"),
    )


def step_coverage(declared: Column, used: Column) -> Column:
    """COMPLETE, 'n MISSING', or UNKNOWN without a declared list of steps."""
    missing = F.size(F.array_except(declared, used))
    return F.when(declared.isNull(), "UNKNOWN").when(missing == 0, "COMPLETE").otherwise(F.concat(missing.cast("string"), F.lit(" MISSING")))


def grounded(values: Column, support: Column) -> Column:
    """Whether all values appear in the support."""
    return F.size(F.array_except(values, support)) == 0


def referenced(snapshots: DataFrame, resources: DataFrame) -> DataFrame:
    """resource, blocked: whether any snapshot names it; null where one could not be read.

    snapshots: run, resources (array; null for a malformed one).
    """
    named = snapshots.select(F.explode("resources").alias("resource")).distinct().withColumn("hit", F.lit(True))
    broken = snapshots.agg(F.bool_or(F.col("resources").isNull()).alias("broken"))
    rows = resources.join(named, "resource", "left").crossJoin(F.broadcast(broken))
    return rows.select("resource", F.when(F.col("hit"), True).when(~F.coalesce("broken", F.lit(False)), False).alias("blocked"))


def catalog_ids(pages: DataFrame) -> DataFrame:
    """pages with id 'W1', 'W2', ...: knowledge first, then by title and version."""
    rows = pages.withColumn("__last", (F.col("kind") != "knowledge").cast("int"))
    return numbered(rows, "__n", "__last", "title", "version").withColumn("id", F.concat(F.lit("W"), F.col("__n"))).drop("__n", "__last")


def passage_conflicts(units: DataFrame) -> DataFrame:
    """unit, query_rank: units with one passage only; repeats keep the least rank, conflicting ones go."""
    rows = units.groupBy("unit").agg(F.countDistinct("passage").alias("n"), F.min("query_rank").alias("query_rank"))
    return rows.where("n = 1").select("unit", "query_rank")


def routes(rows: DataFrame, primary: Column) -> DataFrame:
    """page, priority, queries: routes merged per page, primary ones first, the least priority counts."""
    out = rows.groupBy("page").agg(F.min("priority").alias("priority"), F.sort_array(F.collect_set("query")).alias("queries"), F.bool_or(primary).alias("primary"))
    return numbered(out.withColumn("__last", ~F.col("primary")), "place", "__last", "priority", "page").drop("__last")


def windows(length: Column, size: int, overlap: int) -> Column:
    """Half-open token windows of `size` with an overlap, the last one cut at the end."""
    step = size - overlap
    count = F.greatest(F.ceil((length - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length).alias("end")))
    return F.when(length > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def window_scores(scored: DataFrame, key: str) -> DataFrame:
    """Best score over the windows of each key."""
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def iso_date(text: Column) -> Column:
    """The first year-month-day in a text as a date; null if there is none or it does not exist."""
    pattern = r"(\d{4})\s*[-年/.]\s*(\d{1,2})\s*[-月/.]\s*(\d{1,2})"
    part = lambda n: F.lpad(F.regexp_extract(text, pattern, n), 2, "0") if n > 1 else F.regexp_extract(text, pattern, n)
    return F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")


def library_map(pages: DataFrame, by: list[str]) -> DataFrame:
    """One line per group: its pages' titles in order, joined."""
    return pages.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", "page"))), lambda p: p["title"]), "; ").alias("titles"))


def best_by_terms(pages: DataFrame, terms: Column, title: str, key: str) -> DataFrame:
    """Pages with the greatest number of terms in their title, if any has one.

    Compared null-safely: from a plain equality Spark infers a filter on the greatest
    number that still asks for the title, and fails once the aggregate is shuffled.
    """
    rows = pages.withColumn("n", F.size(F.filter(terms, lambda t: F.contains(F.lower(title), t)))).where("n > 0")
    most = rows.agg(F.max("n").alias("most"))
    return rows.join(F.broadcast(most), F.col("n").eqNullSafe(F.col("most"))).select(key, "n")


def neighbours(edges: DataFrame, page: DataFrame) -> DataFrame:
    """page, dst, why: one hop along typed edges, incoming exceptions, and citations."""
    out = edges.join(page, edges["src"] == page["page"]).select("page", F.col("dst"), F.when(F.col("type") == "CITES", "citation").otherwise("relation").alias("why"))
    back = edges.where("type = 'EXCEPTION_OF'").join(page, edges["dst"] == page["page"]).select("page", F.col("src").alias("dst"), F.lit("exception").alias("why"))
    return out.unionByName(back).distinct()


def drifted(inputs: DataFrame, current: DataFrame) -> DataFrame:
    """Pages with a frozen input version below the current one, and how many."""
    rows = inputs.join(current.withColumnRenamed("version", "now"), "resource").where("version < now")
    return rows.groupBy("page").agg(F.count("*").alias("n_drifted"))


def readable_runs(uses: DataFrame, readable: DataFrame) -> DataFrame:
    """Runs all of whose sources are readable (uses: run, version)."""
    bad = uses.join(readable.select("version"), "version", "left_anti").select("run").distinct()
    return uses.select("run").distinct().join(bad, "run", "left_anti")

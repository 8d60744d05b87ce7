"""Duplicates, coverage, gaps and citations of a knowledge base."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.constants import GAP_RUNS, TITLE_SIMILARITY
from lodestone.functions.similarity import may_reach, ratio
from lodestone.functions.text import gap_key
from lodestone.session import materialise, worker_path

#: Titles of a chunk, and characters of one of them; a longer title counts as several.
TITLE_CHUNK, TITLE_LENGTH = 2_000, 400


def body_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """body, first, n: groups of rows with the same text; pairs within them are not spelled out."""
    return docs.groupBy(F.sha2(text, 256).alias("body")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def body_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: every further row of a body with the first one, which names the group."""
    hashed = docs.select(F.col(key).alias("b"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("body"))
    return hashed.join(hashed.groupBy("body").agg(F.min("b").alias("a")), "body").where("a < b").select("a", "b")


def name_pairs(names: DataFrame) -> DataFrame:
    """a, b: pages that share a name (page, name), each with the first page of the name."""
    rows = names.select(F.col("page").alias("b"), F.coalesce(F.concat(F.lit("="), F.col("name")), F.lit("")).alias("name"))
    return rows.join(rows.groupBy("name").agg(F.min("b").alias("a")), "name").where("a < b").select("a", "b").distinct()


def title_cells(once: DataFrame, least: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Titles (block, title, page) with their chunk, and cells (block, x, y) of two chunks that may hold similar ones, x <= y.

    The rank of a title is that of its length and a place by hash among those as
    long, so nothing but lengths is sorted. Long titles count as several, by which
    chunks take about as much memory. A chunk meets itself and the later ones that
    begin within the reach of its longest title.
    """
    once = materialise(once.withColumn("length", F.length("title")), "titles")
    weight = F.ceil(F.col("length") / F.lit(TITLE_LENGTH))
    before = F.sum(F.col("n") * weight).over(Window.partitionBy("block").orderBy("length")) - F.col("n") * weight
    lengths = once.groupBy("block", "length").agg(F.count("*").alias("n")).withColumn("before", before)
    place = F.col("before") + F.pmod(F.xxhash64("title"), F.col("n")) * weight
    dealt = once.join(lengths, ["block", "length"]).withColumn("chunk", F.floor(place / F.lit(chunk)).cast("int"))
    dealt = materialise(dealt.select("block", "chunk", "length", "page", "title"), "chunks")
    sizes = dealt.groupBy("block", "chunk").agg(F.min("length").alias("shortest"), F.max("length").alias("longest"))
    later = sizes.select("block", F.col("chunk").alias("y"), F.col("shortest").alias("begin"))
    # A little more than the factor: rounding parts no pair.
    reach = F.col("longest") * F.lit((2 - least) / max(least, 1e-9) * (1 + 1e-9))
    cells = sizes.join(later, "block").where((F.col("y") >= F.col("chunk")) & (F.col("begin") <= reach))
    return dealt, materialise(cells.select("block", F.col("chunk").alias("x"), "y"), "cells")


def similar_titles(titles: DataFrame, least: float = TITLE_SIMILARITY, chunk: int = TITLE_CHUNK) -> DataFrame:
    """a, b, similarity: titles (page, block, title) of one block that match to `least` or more.

    Equal titles of a block are compared once, by their least page. Every further
    page of a title comes as a pair of that page and itself, with similarity 1, so
    that a page's links are those of its title's least page. The ratio depends on
    the order of its titles: the one with the lesser of the two pages is first.

    The Ratcliff-Obershelp ratio is at most twice the shorter length over the sum
    of both, so only titles whose lengths lie within a factor of (2 - least) / least
    can reach it. The titles of a block are dealt to chunks in the order of their
    length, and chunks meet within that reach. Pairs pass an exact filter before
    the ratio is taken.
    """
    rows = titles.where(F.length("title") > 0).select("block", "title", F.col("page").cast("long").alias("page"))
    rows = rows.withColumn("block", F.coalesce("block", F.lit("")))
    once = rows.groupBy("block", "title").agg(F.min("page").alias("page"))
    copies = rows.join(once.withColumnRenamed("page", "a"), ["block", "title"]).where("page > a").select("a", F.col("page").alias("b"), F.lit(1.0).alias("similarity"))

    dealt, cells = title_cells(once, least, chunk)
    # As many tasks as cells ask for: there are more with more titles, but none is larger.
    spark = titles.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells.count(), 20_000))
    ends = cells.select("block", F.col("x").alias("chunk"), "x", "y", F.lit(False).alias("right")).unionByName(cells.where("x < y").select("block", F.col("y").alias("chunk"), "x", "y", F.lit(True).alias("right")))
    met = dealt.join(ends, ["block", "chunk"]).select("block", "x", "y", "right", "page", "title")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        pages, texts, side = part["page"].to_pylist(), part["title"].to_pylist(), part["right"].to_pylist()
        left = [k for k, s in enumerate(side) if not s]
        right = None if key[1] == key[2] else [k for k, s in enumerate(side) if s]
        out = []
        for found in may_reach([texts[k] for k in left], None if right is None else [texts[k] for k in right], least):
            for i, j in zip(*(f.tolist() for f in found), strict=True):
                (a, s), (b, t) = sorted((pages[k], texts[k]) for k in (left[i], (left if right is None else right)[j]))
                if a != b and (r := ratio(s, t)) >= least:
                    out.append((a, b, r))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    cell_key = ["block", "x", "y"]
    pairs = met.repartition(tasks, *cell_key).groupBy(*cell_key).applyInArrow(run, "a long, b long, similarity double")
    return pairs.unionByName(copies).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def merge_signals(*signals: DataFrame) -> DataFrame:
    """a, b, methods: pairs of several (a, b, method) sources as one candidate each."""
    rows = signals[0]
    for s in signals[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("a", "b").agg(F.sort_array(F.collect_set("method")).alias("methods"))


def gaps(runs: DataFrame, user: Column, max_runs: int = GAP_RUNS) -> DataFrame:
    """Declared gaps of the latest completed runs, by normalised material.

    runs: run_id, owner_id, created_at, phases (arrays of 'material｜purpose' in
    order). Per material: runs, first and last seen, up to five purposes and up
    to five runs of the user.
    """
    recent = runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(max_runs)
    rows = recent.select("run_id", "owner_id", "created_at", F.posexplode("phases").alias("at", "raw"))
    parts = F.split("raw", "｜", 2)
    rows = rows.select("run_id", "owner_id", "created_at", "at", F.trim(parts[0]).alias("material"), F.when(F.size(parts) > 1, F.trim(parts[1])).alias("purpose")).withColumn("key", gap_key(F.col("material"))).where("key <> ''")
    once = rows.groupBy("key", "run_id", "owner_id", "created_at").agg(F.min(F.struct("at", "material", "purpose")).alias("g"))
    order = F.struct(-F.unix_timestamp("created_at").alias("t"), F.col("run_id"))
    found = once.groupBy("key").agg(
        F.count("*").alias("runs"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.min(F.struct(order.alias("o"), F.col("g.material").alias("gap")))["gap"].alias("gap"),
        F.slice(F.array_sort(F.collect_set(F.when(F.coalesce(F.col("g.purpose"), F.lit("")) != "", F.col("g.purpose")))), 1, 5).alias("purposes"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("owner_id") == user, F.col("run_id")))), 1, 5).alias("own_run_ids"),
    )
    return found.drop("key")


def query_coverage(routes: DataFrame, read: DataFrame) -> DataFrame:
    """Per query: state and the anchors still to read.

    routes: query_id, page, kind ('source' or 'wiki'); read: page. SOURCE_READ if a
    source page was read, WIKI_ONLY if only wiki pages were, UNREAD if none,
    NO_CANDIDATE for a query whose page is null throughout.
    """
    seen = routes.join(read.select("page", F.lit(True).alias("done")).distinct(), "page", "left")
    done = F.coalesce(F.col("done"), F.lit(False))
    rows = seen.groupBy("query_id").agg(
        F.count("page").alias("n_routes"), F.bool_or(done & (F.col("kind") == "source")).alias("source"), F.bool_or(done & (F.col("kind") == "wiki")).alias("wiki"),
        F.sort_array(F.collect_set(F.when(~done, F.col("page")))).alias("next"),
    )
    state = F.when(F.col("n_routes") == 0, "NO_CANDIDATE").when(F.col("source"), "SOURCE_READ").when(F.col("wiki"), "WIKI_ONLY").otherwise("UNREAD")
    return rows.select("query_id", state.alias("state"), "next")


def primary_coverage(required: DataFrame, facts: DataFrame) -> DataFrame:
    """Per rule: whether all required sources are read and cited, and any candidate is.

    required: rule, source, needed; facts: source, is_read, is_cited.
    """
    rows = required.join(facts, "source", "left").withColumn("ok", F.coalesce(F.col("is_read") & F.col("is_cited"), F.lit(False)))
    return rows.groupBy("rule").agg(F.bool_and(F.when(F.col("needed"), F.col("ok"))).alias("all_required"), F.bool_or(F.when(~F.col("needed"), F.col("ok"))).alias("any_candidate"))


def bundles(blocks: DataFrame, citations: DataFrame, eligible: DataFrame) -> DataFrame:
    """Blocks (block) all of whose citations (block, cited) are eligible, with how many they cite; one bad citation drops the block."""
    ok = citations.join(eligible.select(F.col("block").alias("cited"), F.lit(True).alias("good")), "cited", "left")
    whole = ok.groupBy("block").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("good", F.lit(False))).alias("whole"))
    return blocks.join(whole, "block", "left").where(F.coalesce("whole", F.lit(True))).select("block", F.coalesce("n", F.lit(0)).alias("n_cited"))


def resolve_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """name, state, target: RESOLVED if the name leads to one canonical target, AMBIGUOUS if to several, else NOT_FOUND.

    names: name, target (canonical).
    """
    targets = names.groupBy("name").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    rows = asked.select("name").distinct().join(targets, "name", "left")
    state = F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return rows.select("name", state.alias("state"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def collisions(names: DataFrame) -> DataFrame:
    """Names that belong to more than one canonical target."""
    return names.groupBy("name").agg(F.countDistinct("target").alias("n")).where("n > 1")


def dispositions(passages: DataFrame, cited: DataFrame) -> DataFrame:
    """Passages (passage, status), where EXTRACTED ones that nothing cites become NEEDS_REVIEW."""
    rows = passages.join(cited.select("passage", F.lit(True).alias("used")).distinct(), "passage", "left")
    return rows.withColumn("status", F.when((F.col("status") == "EXTRACTED") & F.col("used").isNull(), "NEEDS_REVIEW").otherwise(F.col("status"))).drop("used")


def citation_map(paragraphs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per paragraph (paragraph, text): linked sources and distinct versions of the [En] marks in it.

    sources: evidence (n), version.
    """
    marks = paragraphs.select("paragraph", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[E(\d+)\]"), F.lit(1)))).alias("mark"))
    rows = marks.withColumn("evidence", F.col("mark").cast("long")).join(sources, "evidence", "left")
    return rows.groupBy("paragraph").agg(F.count("mark").alias("n_marks"), F.count("version").alias("n_linked"), F.countDistinct("version").alias("n_versions"))


def occurrences(names: DataFrame, texts: DataFrame, block: int = 200_000) -> DataFrame:
    """src, name, n: how often each text (src, text) holds each name (name); uses of one name don't overlap.

    Names are dealt to blocks of about `block`; an automaton of each block reads the
    texts once, so no name meets a text that doesn't hold it.
    """
    worker_path(texts.sparkSession)
    fit = names.select("name").where("name <> ''").distinct()
    blocks = -(-fit.count() // block) or 1
    source = texts.schema["src"].dataType.simpleString()

    def found(part: list[str]) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = ahocorasick.Automaton()
            for name in shared.value:
                auto.add_word(name, name)
            auto.make_automaton()
            for batch in batches:
                at, of, times = [], [], []
                for i, t in enumerate(batch.column(1)):
                    text = t.as_py() or ""
                    for name in {n for _, n in auto.iter(text)} if len(auto) else ():
                        at.append(i)
                        of.append(name)
                        times.append(text.count(name))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(of, pa.string()), pa.array(times, pa.int64())], names=["src", "name", "n"])

        return texts.select("src", "text").mapInArrow(run, f"src {source}, name string, n long")

    parts = [found([r[0] for r in fit.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == at).collect()]) for at in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def mentions(names: DataFrame, pages: DataFrame, connected: DataFrame, block: int = 200_000) -> DataFrame:
    """src, dst, n: pages whose text names another page often enough and that aren't connected yet.

    names (dst, name) are looked up in all pages (src, text). A name of eight
    characters counts from its first use, a shorter one from its second; plain
    ASCII names need four.
    """
    fit = names.where((F.length("name") >= 4) | ~F.col("name").rlike(r"^[\x00-\x7F]*$")).distinct()
    rows = occurrences(fit, pages, block).where((F.col("n") >= 2) | (F.length("name") >= 8)).join(fit, "name").where("src <> dst")
    return rows.groupBy("src", "dst").agg(F.sum("n").alias("n")).join(connected.select("src", "dst"), ["src", "dst"], "left_anti")


def upserts(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """outcome, n: created, updated, unchanged and kept rows of a full-document comparison (key, doc)."""
    rows = new.select(key, F.sha2("doc", 256).alias("h")).join(old.select(key, F.sha2("doc", 256).alias("was")), key, "full")
    outcome = F.when(F.col("was").isNull(), "created").when(F.col("h").isNull(), "kept").when(F.col("h") == F.col("was"), "unchanged").otherwise("updated")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))

"""Links that pages state in their text, resolved against the names of the current catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.text import name_key, wikilinks
from lodestone.operators.graph import roots
from lodestone.session import materialise


def invalid_pages(blocks: DataFrame) -> DataFrame:
    """Pages (page) one of whose blocks (page, text, content_sha256) isn't what its hash says."""
    good = F.coalesce(F.sha2("text", 256) == F.col("content_sha256"), F.lit(False))
    return blocks.groupBy("page").agg(F.bool_and(good).alias("good")).where("not good").select("page")


def _ends(pages: DataFrame, names: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that can be read (page, kind); and token, root for every page that bears a name, null where it has no readable end."""
    known = materialise(pages.join(bad, "page", "left_anti").select("page", "kind", "canonical", F.coalesce("canonical_open", F.lit(True)).alias("open")), "pages")
    closed = known.where("not open").select(F.col("page").alias("root"))
    ends = roots(known.select(F.col("page").alias("node"), F.when(F.col("open") & (F.col("canonical") != F.col("page")), F.col("canonical")).alias("target")))
    # An end that dropped out, or whose canonical page is closed, is none.
    ends = ends.join(known.select(F.col("page").alias("root")), "root", "left_semi").join(closed, "root", "left_anti").select(F.col("node").alias("bearer"), "root")
    bearers = names.select(name_key("name").alias("token"), F.col("page").alias("bearer")).where("token <> ''").distinct()
    return known.select("page", "kind"), bearers.join(ends, "bearer", "left").select("token", "root").distinct()


def inline_links(pages: DataFrame, names: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, token, state, target, n_candidates: where the wiki links of knowledge pages lead.

    pages: page, kind, canonical (null: itself), canonical_open (false: its canonical page
    can't be read; null: it can); names: page, name; blocks: page, text,
    content_sha256. Pages with a block that isn't what its hash says drop out on both
    ends. A name (token: its key) leads to the canonical ends of all pages that bear it: to one, LINK; to
    several, AMBIGUOUS (candidates() has them, once for each name and not for each page); if one of them has no readable end, or no page
    bears the name, UNAVAILABLE, so that a page that can't be read never makes another
    one's name unique. Links of a page to itself are left out; a page's link comes once for each name.
    """
    known, bearers = _ends(pages, names, materialise(invalid_pages(blocks), "invalid"))
    asked = blocks.join(known.where("kind = 'knowledge'").select("page"), "page", "left_semi").select("page", F.explode(wikilinks(F.col("text"))).alias("name"))
    asked = asked.select("page", name_key("name").alias("token")).where("token <> ''").distinct()
    # Bearers are counted by name before they meet the pages that ask.
    per = bearers.groupBy("token").agg(F.min("root").alias("root"), F.count("root").alias("n_candidates"), F.bool_or(F.col("root").isNull()).alias("lost"))
    rows = asked.join(per, "token", "left")
    state = F.when(F.col("lost").isNull() | F.col("lost"), "UNAVAILABLE").when(F.col("n_candidates") > 1, "AMBIGUOUS").otherwise("LINK")
    rows = rows.select("page", "token", state.alias("state"), "root", "n_candidates")
    rows = rows.where("state <> 'LINK' or root <> page")
    return rows.select("page", "token", "state", F.when(F.col("state") == "LINK", F.col("root")).alias("target"), F.when(F.col("state") == "AMBIGUOUS", F.col("n_candidates")).alias("n_candidates"))


def candidates(pages: DataFrame, names: DataFrame, blocks: DataFrame) -> DataFrame:
    """token, target: the readable canonical ends of names that lead to several, and to nothing that can't be read."""
    _, bearers = _ends(pages, names, materialise(invalid_pages(blocks), "invalid"))
    bearers = materialise(bearers, "bearers")
    several = bearers.groupBy("token").agg(F.count("root").alias("n"), F.bool_or(F.col("root").isNull()).alias("lost")).where("n > 1 and not lost")
    return bearers.join(several.select("token"), "token", "left_semi").select("token", F.col("root").alias("target"))

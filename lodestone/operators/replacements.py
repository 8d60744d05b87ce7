"""Replacement facts that texts state, and suggestions of facts to register: column expressions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.functions import replacements as P
from lodestone.functions.text import nfkc
from lodestone.session import materialise


def title_keys(title: Column) -> Column:
    """Keys that a title is found by: NFKC without white space, endings of files and brackets; and that of the short form of its issuer."""
    value = F.regexp_replace(F.element_at(F.split(nfkc(F.coalesce(title, F.lit(""))), "[—–]附件[:：]"), -1), "^(?:附件\\d*[:：])+《?", "")
    value = F.regexp_replace(F.regexp_replace(value, "[\\s​﻿]", ""), "(?i)\\.(?:pdf|docx?|html?|txt|md)$", "")
    value = F.regexp_replace(F.regexp_replace(value, "\\((?:官方发布页|转排阅读稿)\\)$", ""), "^[《》:：]+|[《》:：]+$", "")
    short = value
    for long, alias in P.ALIASES.items():
        short = F.when(F.startswith(value, F.lit(long)), F.concat(F.lit(alias), F.substring(value, len(long) + 1, 1 << 20))).otherwise(short)
    return F.filter(F.array_distinct(F.array(value, short)), lambda k: k != "")


def _titles(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _issued(text: Column) -> Column:
    """Titles that a text issues, apart from lists of repealed rules."""
    every = F.concat(*(_titles(text, p) for p in P.ISSUES))
    return F.filter(F.array_distinct(every), lambda t: ~t.rlike(P.LISTS))


def _day(text: Column, pattern: str, first: int = 1) -> Column:
    part = lambda n: F.regexp_extract(text, pattern, first + n).try_cast("int")
    return F.try_to_date(F.format_string("%04d-%02d-%02d", part(0), part(1), part(2)))


def replacement_facts(records: DataFrame) -> DataFrame:
    """version_id, block_id, predecessor, successor (null: not told), effective_from (null: not told), scope, sentence.

    records: version_id, block_id, ordinal, text. A sentence that names a pair, or titles
    in front of a repeal, states a fact for each title; one that is uncertain states none. The
    successor of a repeal is what the sentence issues, else the only title that the text issued up
    to there. Only what is repealed counts as whole if no article or part of it
    is named. The date is the only one on which the text says that something
    begins to hold; if it says that it holds from publication, the only date alone in a block further on.
    """
    order = Window.partitionBy("version_id").orderBy("ordinal")
    body = F.coalesce("text", F.lit(""))
    plain = lambda c: F.regexp_replace(c, P.BOOK, "《文件》")
    whole = Window.partitionBy("version_id")
    starts = _titles(body, f"({P.START})")
    alone = F.when(body.rlike(f"^\\s*{P.DATE}\\s*$"), _day(body, f"^\\s*{P.DATE}"))
    rows = records.select("version_id", "block_id", "ordinal", body.alias("text"), F.when(~plain(body).rlike(P.UNCERTAIN), _issued(body)).alias("issues"), F.transform(starts, lambda s: _day(s, P.START)).alias("starts"), alone.alias("alone"), body.rlike(P.ON_PUBLICATION).alias("on_publication"))
    rows = rows.withColumns({
        "issued": F.array_distinct(F.flatten(F.collect_list("issues").over(order))), "days": F.array_distinct(F.flatten(F.collect_list("starts").over(whole))), "published": F.max("on_publication").over(whole),
        "signed": F.collect_set("alone").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    told = F.when((F.size("days") == 1), F.element_at("days", 1)).when((F.size("days") == 0) & F.col("published") & (F.size("signed") == 1), F.element_at("signed", 1))
    said = rows.select("version_id", "block_id", "issued", told.alias("effective_from"), F.explode(F.split("text", "(?<=[。；;])")).alias("sentence")).where(~plain(F.col("sentence")).rlike(P.UNCERTAIN))
    sentence = F.col("sentence")
    paired = sentence.rlike(P.PAIR)
    pair = F.array(F.struct(F.regexp_extract(sentence, P.PAIR, 2).alias("predecessor"), F.regexp_extract(sentence, P.PAIR, 1).alias("successor"), plain(sentence).rlike("部分|第[^，。；]{1,12}[条款项]").alias("partial")))
    here = F.array_distinct(F.concat(*(_titles(sentence, p) for p in P.ISSUES)))
    before = F.regexp_extract(sentence, f"(?s)^(.*?){P.REPEAL}", 1)
    bits = F.slice(F.split(F.regexp_replace(before, P.BOOK, "\u0001$1\u0002"), "\u0001"), 2, 1 << 20)
    books = F.transform(bits, lambda b: F.struct(F.substring_index(b, "\u0002", 1).alias("title"), F.substring_index(b, "\u0002", -1).alias("tail")))
    titles = F.when(F.size(here) > 0, here).otherwise(F.coalesce("issued", F.array().cast("array<string>")))
    one = F.when(F.size(titles) == 1, F.element_at(titles, 1))
    repealed = F.transform(F.filter(books, lambda b: ~F.array_contains(here, b["title"])), lambda b: F.struct(b["title"].alias("predecessor"), one.alias("successor"), b["tail"].rlike(P.PART).alias("partial")))
    found = said.withColumn("f", F.explode(F.when(paired, pair).when(sentence.rlike(P.REPEAL), repealed)))
    rows = found.where(~F.col("f.predecessor").eqNullSafe(F.col("f.successor")))
    return rows.select("version_id", "block_id", "f.predecessor", "f.successor", "effective_from", F.when(F.col("f.partial"), "partial").otherwise("full").alias("scope"), F.trim(sentence).alias("sentence"))


def suggestions(facts: DataFrame, documents: DataFrame, registered: DataFrame, records: DataFrame) -> DataFrame:
    """status, predecessor, successor, evidence, effective_from, scope, missing: facts to confirm, and those that are.

    facts as replacement_facts() gives them; documents: version_id, titles (its title first, then aliases); registered:
    predecessor, successor, effective_from, scope, state (REVOKED or another). A
    title means the only version that bears one of its keys; the predecessor is
    neither the successor nor the text that states the fact. Without a successor a text that says when it begins to hold itself is it. What is
    registered isn't suggested again, nor any fact of a revoked pair. READY has every field,
    NEEDS_INPUT lacks some, CONFIRMED is registered.
    """
    bears = documents.select(F.col("version_id").alias("bearer"), F.explode("titles").alias("title"))
    bears = materialise(bears.select("bearer", F.explode(title_keys(F.col("title"))).alias("key")).distinct(), "titles")
    own = records.groupBy("version_id").agg(F.bool_or(F.coalesce(F.col("text").rlike(P.OWN_START) & F.col("text").rlike(P.START), F.lit(False))).alias("starts"))
    rows = facts.join(own, "version_id", "left").join(documents.select("version_id", F.element_at("titles", 1).alias("own_title")), "version_id", "left")
    rows = rows.withColumn("successor", F.coalesce("successor", F.when(F.col("starts"), F.col("own_title"))))
    rows = materialise(rows.select("version_id", "predecessor", "successor", "effective_from", "scope").distinct().withColumn("n", F.monotonically_increasing_id()), "facts")

    def meant(column: str) -> DataFrame:
        """n, bearer: versions that a title of the facts may mean; titles are looked up once each."""
        asked = rows.select(F.col(column).alias("title")).where("title is not null").distinct()
        found = asked.withColumn("key", F.explode(title_keys(F.col("title")))).join(bears, "key").select("title", "bearer").distinct()
        return rows.select("n", "version_id", F.col(column).alias("title")).join(found, "title").select("n", "version_id", "bearer")

    only = lambda found, name: found.groupBy("n").agg(F.min("bearer").alias(name), F.max("bearer").alias("other")).where(F.col(name) == F.col("other")).drop("other")
    new = materialise(only(meant("successor"), "new"), "successors")
    old = only(meant("predecessor").join(new, "n", "left").where((F.col("bearer") != F.col("version_id")) & ~F.col("bearer").eqNullSafe(F.col("new"))), "old")
    rows = rows.join(new, "n", "left").join(old, "n", "left")
    known = registered.select(F.col("predecessor").alias("old"), F.col("successor").alias("new"), "effective_from", "scope", "state")
    revoked = known.where("state = 'REVOKED'").select("old", "new").distinct()
    live = known.where("state <> 'REVOKED'")
    alike = lambda a, b, names: F.reduce(F.array(*(F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names)), F.lit(True), lambda x, y: x & y)
    left = rows.alias("r").join(revoked.alias("k"), (F.col("r.old") == F.col("k.old")) & (F.col("r.new") == F.col("k.new")), "left_anti")
    left = left.alias("r").join(live.alias("k"), (F.col("r.old") == F.col("k.old")) & alike("r", "k", ("new", "effective_from", "scope")), "left_anti")
    missing = F.array_compact(F.array(F.when(F.col("old").isNull(), "predecessor"), F.when(F.col("new").isNull(), "successor"), F.when(F.col("effective_from").isNull(), "effective_from")))
    open_ = left.select(F.when(F.size(missing) == 0, "READY").otherwise("NEEDS_INPUT").alias("status"), F.col("old").alias("predecessor"), F.col("new").alias("successor"), F.col("version_id").alias("evidence"), "effective_from", "scope", missing.alias("missing"))
    done = live.select(F.lit("CONFIRMED").alias("status"), F.col("old").alias("predecessor"), F.col("new").alias("successor"), F.lit(None).cast(facts.schema["version_id"].dataType).alias("evidence"), "effective_from", "scope", F.array().cast("array<string>").alias("missing"))
    return open_.unionByName(done)

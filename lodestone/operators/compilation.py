"""Pages that are compiled in batches, and proposed relations between current pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def _union(of: Column, *order: str) -> Column:
    """Distinct entries of arrays, in the order of their rows."""
    return F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, of.alias("of")))), lambda r: r["of"])))


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """page, section, rank, markdown, status, evidence: the batches of a page as one.

    blocks: page, batch, position, section, markdown, status, evidence (array). Of a
    section all supported blocks stay, in the order of batches; equal ones are one,
    with the evidence of all. A section without supported text keeps its first block
    that is not applicable, else its first gap. Further blocks of a section lose a
    heading that leads them.
    """
    body = F.trim(F.regexp_replace("markdown", r"^\s+|\s+$", ""))
    rows = blocks.withColumn("__body", body)
    first = F.min(F.struct("batch", "position", "markdown")).alias("first")
    good = rows.where("status = 'SUPPORTED'").groupBy("page", "section", "__body").agg(first, _union(F.col("evidence"), "batch", "position").alias("evidence"))
    good = good.select("page", "section", "first", F.lit("SUPPORTED").alias("status"), "evidence")
    order = F.when(F.col("status") == "NOT_APPLICABLE", 0).otherwise(1)
    rest = rows.where("status in ('NOT_APPLICABLE', 'GAP')").groupBy("page", "section").agg(F.min(F.struct(order.alias("kind"), "batch", "position", "markdown", "status", "evidence")).alias("b"))
    rest = rest.join(good.select("page", "section").distinct(), ["page", "section"], "left_anti").select("page", "section", F.struct("b.batch", "b.position", "b.markdown").alias("first"), "b.status", "b.evidence")
    w = Window.partitionBy("page", "section").orderBy("first")
    kept = good.unionByName(rest).withColumn("rank", F.row_number().over(w).cast("long"))
    parts = F.split(F.regexp_replace("first.markdown", r"^\s+", ""), "\n", 2)
    bare = F.when((F.col("rank") > 1) & F.startswith(parts[0], F.lit("#")) & (F.size(parts) == 2) & F.element_at(parts, -1).rlike(r"\S"), F.regexp_replace(F.element_at(parts, -1), r"^\n+", ""))
    return kept.select("page", "section", "rank", F.coalesce(bare, F.col("first.markdown")).alias("markdown"), "status", "evidence")


def merged_relations(relations: DataFrame, titles: DataFrame) -> DataFrame:
    """page, source, target, type, evidence: relations of all batches of a page, each once with the evidence of all.

    relations: page, batch, position, source, target, type, evidence. titles: page,
    batch, title: an end that any batch's title of the page names is the first
    batch's title; relations of a page to itself fall away.
    """
    main = titles.groupBy("page").agg(F.min(F.struct("batch", "title"))["title"].alias("main"))
    known = titles.select("page", "title").distinct().join(main, "page")
    rows = relations
    for end in ("source", "target"):
        rows = rows.join(known.select("page", F.col("title").alias(end), F.col("main").alias(f"__{end}")), ["page", end], "left")
    rows = rows.withColumn("source", F.coalesce("__source", "source")).withColumn("target", F.coalesce("__target", "target")).where("source <> target")
    return rows.groupBy("page", "source", "target", "type").agg(_union(F.col("evidence"), "batch", "position").alias("evidence"))


def visible_proposals(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """source, target, type, evidence_count: proposed relations whose ends are both as they were when proposed.

    proposals: source, target, type, anchors and for each end version, epoch and sha
    (source_version, ...); pages: page, version, epoch, sha of what is visible now.
    """
    rows = proposals
    for end in ("source", "target"):
        now = pages.select(F.col("page").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("version", "epoch", "sha")))
        rows = rows.join(now, [end, *(f"{end}_{c}" for c in ("version", "epoch", "sha"))], "left_semi")
    return rows.groupBy("source", "target", "type").agg(F.sum("anchors").alias("evidence_count"))


def capabilities(rows: DataFrame) -> DataFrame:
    """rows (name, id, structured) with their place: structured ones first, each kind by name and id."""
    from lodestone.operators.sequences import numbered

    return numbered(rows.withColumn("__last", ~F.coalesce("structured", F.lit(False))), "place", "__last", "name", "id").drop("__last")

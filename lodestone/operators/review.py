"""Reviews of sources that were read and of answers that cite them: windows over lines, joins on cited evidence.

Reviews of many runs are made at once. Nothing here rewrites a text or judges
what it says; each issue names the evidence or the place in the answer that it rests on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lodestone.functions import review as P
from lodestone.operators.structure import rows_of
from lodestone.session import materialise, worker_path
from lodestone.sources import text as X

_RUN = ["run_id", "version_id"]


def bound(records: DataFrame) -> DataFrame:
    """Records (run_id, evidence, resource_id, version_id, block_id, ordinal, text, content_sha256, ...) that may support a review.

    An evidence number of a run counts if all its rows are one text of one block
    and the hash is that of the text; of rows that repeat one stays. The result is
    written once, as reviews read it several times.
    """
    parts = ("resource_id", "version_id", "block_id", "content_sha256", "text")
    whole = F.col("resource_id").isNotNull() & F.col("version_id").isNotNull() & F.col("block_id").isNotNull() & (F.sha2("text", 256) == F.col("content_sha256"))
    of = Window.partitionBy("run_id", "evidence")
    sign = F.xxhash64(*parts)
    rows = records.where("evidence > 0").withColumn("_one", (F.min(sign).over(of) == F.max(sign).over(of)) & whole)
    return materialise(rows.where("_one").drop("_one").dropDuplicates(["run_id", "evidence"]), "bound")


def _lines(records: DataFrame) -> DataFrame:
    """Lines of bound records in the order of their version, and whether one starts a run of neighbouring blocks."""
    order = Window.partitionBy(*_RUN).orderBy("ordinal", "block_id", "line")
    rows = records.select(*_RUN, "ordinal", "block_id", "evidence", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    before = F.lag("ordinal").over(order)
    same = F.coalesce((F.lag("block_id").over(order) == F.col("block_id")) | (before + 1 == F.col("ordinal")), F.lit(False))
    return rows.withColumn("opens", ~same)


def _one_sided(lines: DataFrame, by: list[str], order: list[str], breaks: Column, shut: Column | None = None) -> DataFrame:
    """by, entries: runs of two or more booking lines of one side.

    A run ends before a line that `breaks`, which may begin the next one, and at
    lines of other kinds that close an entry, unless they are `shut` away.
    """
    entry = F.col("body").rlike(P.JOURNAL) & ~F.col("body").rlike(P.ALTERNATIVE)
    bare = F.trim("body")
    ends = ~entry & (bare.rlike(P.ENTRY_BOUNDARY) | F.col("body").rlike(P.ALTERNATIVE)) & ~(F.lit(False) if shut is None else shut)
    rows = lines.withColumn("side", F.when(entry, F.regexp_extract("body", P.JOURNAL, 1))).withColumn("cut", (breaks | ends).cast("int"))
    rows = rows.withColumn("island", F.sum("cut").over(Window.partitionBy(*by).orderBy(*order))).where("side is not null")
    groups = rows.groupBy(*by, "island").agg(F.sort_array(F.collect_list(F.struct(*order, "*"))).alias("entries"), F.countDistinct("side").alias("sides"))
    return groups.where((F.col("sides") == 1) & (F.size("entries") > 1)).drop("island", "sides")


def _mode(text: Column) -> Column:
    """The last mode that a text names, without the words that lead to it."""
    found = F.regexp_extract_all(text, F.lit(P.MODE), F.lit(1))
    value = F.when(F.size(found) > 0, F.element_at(found, -1))
    for lead in P.MODE_LEADS:
        value = F.regexp_replace(value, f"^{lead}", "")
    return value


@F.arrow_udf(T.LongType())
def _numeral(words: pa.Array) -> pa.Array:
    """Values of Arabic and Chinese numerals, null for other words; a batch has few different ones."""
    seen = words.dictionary_encode()
    return pa.array([X.numeral(w.as_py()) for w in seen.dictionary], pa.int64()).take(seen.indices)


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with the value of a column of numerals, taken in place: dealt by so few different words, they would meet in a few tasks."""
    worker_path(rows.sparkSession)
    # Spark would take the values again below filters on them, were the function known to be deterministic.
    return rows.withColumn(f"{column}_value", _numeral.asNondeterministic()(column))


def event_facts(records: DataFrame) -> DataFrame:
    """run_id, version_id, event, aliases, mode, day, day_kind, evidence: what sources say happens on which day.

    A heading that names a day holds for the lines below it until the next one, an
    article or a gap between blocks; a mode holds until then too. Lines that deny
    something state no fact. evidence lists the lines of day, mode and event.
    """
    body = F.col("body")
    lines = _lines(records).withColumns({"heads": body.rlike(P.DAY_HEADING_LEAD + P.DAY), "mode_here": _mode(body)})
    order = Window.partitionBy(*_RUN).orderBy("ordinal", "block_id", "line")
    resets = F.col("opens") | F.col("heads") | body.rlike(P.ARTICLE)
    lines = lines.withColumn("part", F.sum(resets.cast("int")).over(order))
    inside = Window.partitionBy(*_RUN, "part").orderBy("ordinal", "block_id", "line")
    carried = {
        "day_word": F.first(F.when(F.col("heads"), F.regexp_extract(body, P.DAY, 1))).over(inside), "day_kind": F.first(F.when(F.col("heads"), F.regexp_extract(body, P.DAY, 2))).over(inside),
        "day_evidence": F.first(F.when(F.col("heads"), F.col("evidence"))).over(inside), "mode": F.last("mode_here", True).over(inside), "mode_evidence": F.last(F.when(F.col("mode_here").isNotNull(), F.col("evidence")), True).over(inside),
    }
    lines = lines.withColumns(carried).where(F.col("day_word").isNotNull() & ~body.rlike(P.NEGATIVE))
    named = F.transform(F.regexp_extract_all(body, F.lit(P.EVENT), F.lit(1)), lambda e: F.regexp_replace(F.trim(e), "日$", ""))
    named = F.transform(F.filter(named, lambda e: F.length(e).between(2, 16)), lambda e: F.struct(e.alias("event"), F.array(e).alias("aliases")))
    verbs, objects = (F.regexp_extract_all(body, F.lit(P.ACTION), F.lit(n)) for n in (1, 2))
    acts = F.zip_with(verbs, objects, lambda v, o: F.struct(v.alias("verb"), F.trim(F.substring_index(o, "的", -1)).alias("noun")))
    acts = F.transform(F.filter(acts, lambda a: F.length(a["noun"]).between(2, 8)), lambda a: F.struct(F.concat(a["verb"], a["noun"]).alias("event"), F.array(F.concat(a["verb"], a["noun"]), F.concat(a["noun"], a["verb"])).alias("aliases")))
    rows = lines.withColumn("e", F.explode(F.concat(named, acts)))
    found = F.array_distinct(F.array_compact(F.array("day_evidence", "mode_evidence", "evidence")))
    rows = rows.select(*_RUN, F.col("e.event").alias("event"), F.col("e.aliases").alias("aliases"), "mode", "day_word", "day_kind", found.alias("evidence"))
    return _numbered(rows, "day_word").where("day_word_value is not null").withColumn("day", F.col("day_word_value").cast("int")).drop("day_word", "day_word_value")


def source_summary(records: DataFrame) -> DataFrame:
    """run_id, version_id, scope_evidence, basis, years: where a source limits its scope, the price bases it names, years of its title."""
    years = F.sort_array(F.array_distinct(F.regexp_extract_all(F.first("title"), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))))
    scope = F.sort_array(F.collect_set(F.when(F.col("text").rlike(P.SCOPE), F.col("evidence"))))
    basis = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.regexp_extract_all("text", F.lit(P.BASIS), F.lit(1))))))
    return records.groupBy(*_RUN).agg(scope.alias("scope_evidence"), basis.alias("basis"), years.alias("years"))


def _issue(rows: DataFrame, code: str, severity: str, evidence: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("int")
    return rows.select("run_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.sort_array(F.array_distinct(evidence)).alias("evidence"), (none if start is None else start.cast("int")).alias("start"), (none if end is None else end.cast("int")).alias("end"))


def _two_bases(records: DataFrame, code: str) -> DataFrame:
    """An issue for each run of which different versions use the two price bases."""
    rows = records.select("run_id", "version_id", "evidence", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(P.BASIS), F.lit(1)))).alias("basis"))
    runs = rows.groupBy("run_id").agg(F.countDistinct("basis").alias("bases"), F.countDistinct("version_id").alias("versions"), F.collect_set("evidence").alias("evidence"))
    return _issue(runs.where("bases = 2 and versions > 1"), code, "warning", F.col("evidence"))


def source_issues(records: DataFrame) -> DataFrame:
    """run_id, code, severity, evidence, start, end: what is odd about bound records (with applies, which may be null).

    Sources that don't apply, one-sided bookings, and different price bases in different sources.
    """
    unfit = records.where("not applies").groupBy(*_RUN).agg(F.collect_set("evidence").alias("evidence"))
    sided = _one_sided(_lines(records), _RUN, ["ordinal", "block_id", "line"], F.col("opens"))
    return (
        _issue(unfit, "SOURCE_APPLICABILITY_MISMATCH", "warning", F.col("evidence"))
        .unionByName(_issue(sided, "SOURCE_JOURNAL_SIDE_ANOMALY", "critical", F.transform("entries", lambda e: e["evidence"])))
        .unionByName(_two_bases(records, "SOURCE_RULE_BASIS_COMPARISON"))
    )


def answer_issues(answers: DataFrame, records: DataFrame) -> DataFrame:
    """run_id, code, severity, evidence, start, end: what an answer (run_id, text; one per run) makes of the records it cites.

    Issues of cited sources, different price bases among cited records, one-sided
    bookings in the answer, conclusions wider than a cited scope, and events put on
    another day than the cited source states. Fenced and quoted lines state nothing
    but bookings.
    """
    lines = materialise(rows_of(answers, P.answer_lines, "line int, start int, end int, fence boolean, fenced boolean, hidden boolean, cited array<int>, body string", "run_id"), "lines")
    cited = lines.select("run_id", F.explode("cited").alias("evidence")).distinct().join(records, ["run_id", "evidence"])
    known = source_issues(records).where("code <> 'SOURCE_RULE_BASIS_COMPARISON'")
    used = known.join(cited.groupBy("run_id").agg(F.collect_set("evidence").alias("used")), "run_id").where(F.arrays_overlap("evidence", "used")).drop("used")

    blank = (F.trim("body") == "") & ~F.col("fenced")
    sided = _one_sided(lines, ["run_id"], ["line"], F.col("fence") | blank, F.col("fenced"))
    first, last = F.element_at("entries", 1), F.element_at("entries", -1)

    stating = lines.where("not hidden")
    at = stating.select("run_id", "line", "start", "end", "body", F.explode("cited").alias("evidence")).join(records.select("run_id", "evidence", "version_id", F.col("text").alias("source")), ["run_id", "evidence"])
    wide = at.where(F.col("body").rlike(P.EXPANSION) & ~F.col("body").rlike(P.NEGATIVE) & F.col("source").rlike(P.SCOPE))
    wide = wide.groupBy("run_id", "line", "start", "end").agg(F.collect_set("evidence").alias("evidence"))

    clauses = stating.select("run_id", "line", "start", "end", F.posexplode(F.split("body", "[；;。]")).alias("clause", "said"))
    here = {"word": F.when(F.col("said").rlike(P.DAY), F.regexp_extract("said", P.DAY, 1)), "kind": F.when(F.col("said").rlike(P.DAY), F.regexp_extract("said", P.DAY, 2))}
    along = Window.partitionBy("run_id", "line").orderBy("clause")
    clauses = clauses.withColumns(here).withColumns({c: F.last(c, True).over(along) for c in here}).where(F.col("word").isNotNull() & ~F.col("said").rlike(P.NEGATIVE))
    clauses = _numbered(clauses.withColumn("said_mode", _mode(F.col("said"))), "word")
    facts = event_facts(records).withColumn("one", F.explode("evidence"))
    met = clauses.join(at.select("run_id", "line", F.col("evidence").alias("one")), ["run_id", "line"]).join(facts, ["run_id", "one"])
    met = met.where((F.col("kind") == F.col("day_kind")) & F.exists("aliases", lambda a: F.contains(F.col("said"), a)) & (F.col("said_mode").isNull() | F.col("said_mode").eqNullSafe(F.col("mode"))))
    days = met.groupBy("run_id", "line", "clause", "event").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("word_value").alias("said_day"), F.min("day").alias("day"), F.max("day").alias("other"), F.flatten(F.collect_set("evidence")).alias("evidence"))
    moved = days.where((F.col("day") == F.col("other")) & ~F.col("said_day").eqNullSafe(F.col("day")))
    return (
        used.unionByName(_two_bases(cited, "ANSWER_RULE_BASIS_COMPARISON"))
        .unionByName(_issue(sided, "ANSWER_JOURNAL_SIDE_ANOMALY", "critical", F.array().cast("array<int>"), first["start"], last["end"]))
        .unionByName(_issue(wide, "ANSWER_SCOPE_EXTENSION_REVIEW", "warning", F.col("evidence"), F.col("start"), F.col("end")))
        .unionByName(_issue(moved, "ANSWER_EVENT_DAY_CONFLICT", "critical", F.col("evidence"), F.col("start"), F.col("end")))
    )


def answer_status(answers: DataFrame, issues: DataFrame) -> DataFrame:
    """run_id, status, issue_count, critical_count of every answer."""
    counts = issues.groupBy("run_id").agg(F.count("*").alias("issue_count"), F.count_if(F.col("severity") == "critical").alias("critical_count"))
    rows = answers.select("run_id").join(counts, "run_id", "left").fillna(0, ["issue_count", "critical_count"])
    return rows.select("run_id", F.when(F.col("issue_count") > 0, "REVIEW_REQUIRED").otherwise("NO_STRUCTURAL_FINDING").alias("status"), "issue_count", "critical_count")

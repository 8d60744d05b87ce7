"""What documents say about their origin, what texts say was done, and the order of steps: column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.functions import metadata as P
from lodestone.functions.text import nfkc


def named_issuer(text: Column) -> Column:
    """The issuer whose name comes first in a short text, of names that begin together the longest; null without one."""
    names = [(name, form) for name, forms in P.ISSUERS.items() for form in forms]
    found = F.array(*(F.struct(F.call_function("locate", F.lit(form), text).alias("at"), F.lit(-len(form)).alias("size"), F.lit(name).alias("name")) for name, form in names))
    return F.array_min(F.filter(found, lambda f: f["at"] > 0))["name"]


def _number(text: Column) -> Column:
    """A document number without spaces; a 日 that a date in front of it ends in isn't part of it."""
    return F.regexp_replace(F.regexp_replace(text, "\\s+", ""), "^[年月日]", "")


def _first(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.element_at(values, 1))


def origins(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, issuer, located, number, published: who issued a document (key, title, text), where that is stated, its own number and date.

    The number stands in a metadata table among the first 40 lines, in the title,
    in a record of publication at the head, or alone in a line; numbers that the text
    cites are none. The issuer stands in the title, the metadata table, the beginning of the
    number, or alone in one of the first or last eight lines (with a date at most).
    Rows are read as they come, nothing is joined; repeated keys stay apart. What
    many expressions refer to is a column of its own, so that it is taken once for a row.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = docs.select(F.col(key), nfkc(F.coalesce("title", F.lit(""))).alias("title"), lines.alias("lines")).withColumn("head", nfkc(F.array_join(F.slice("lines", 1, 40), "\n")))
    ends = F.array_distinct(F.concat(F.slice("lines", 1, 8), F.reverse(F.slice(F.reverse("lines"), 1, 8))))
    cell = lambda name: F.nullif(F.trim(F.coalesce(*(F.nullif(F.regexp_extract("head", p, 1), F.lit("")) for p in P.CELLS[name]), F.lit(""))), F.lit(""))
    rows = rows.withColumns({f"{n}_cell": cell(n) for n in P.CELLS})
    whole = F.lit(f"({P.NUMBER})")
    in_cell = F.coalesce(_first(F.regexp_extract_all("number_cell", whole, F.lit(1))), F.substring("number_cell", 1, 40))
    in_title = F.when(~F.col("title").rlike(P.ANNEX), _first(F.regexp_extract_all("title", F.lit(f"(?<!关于.{{0,2}})({P.NUMBER})(?!文件)"), F.lit(1))))
    joined = F.regexp_replace("head", "\\s*\n\\s*", "")
    records = F.filter(F.regexp_extract_all(joined, F.lit(f"({P.RECORD})"), F.lit(1)), lambda r: ~r.rlike("根据|依据|废止"))
    dated = F.transform(records, lambda r: F.struct(_first(F.regexp_extract_all(r, whole, F.lit(1))).alias("number"), F.regexp_extract(r, f"^(.*?)(?:{P.PUBLISHED})", 1).alias("before")))
    told = F.filter(dated, lambda r: r["number"].isNotNull() | r["before"].rlike(P.DATE))
    rows = rows.withColumn("told", told).withColumn("record", _first(F.col("told")))
    alone = F.filter(F.transform(F.split("head", "\n"), F.trim), lambda x: x.rlike(f"{P.NUMBER}") & ~x.rlike(P.CITED) & ~F.contains(x, F.lit("《")) & ~F.contains(x, F.lit("\t")) & (F.length(x) <= F.length(F.regexp_extract(x, f"({P.NUMBER})", 1)) + 10))
    rows = rows.withColumn("alone", alone)
    in_line = F.regexp_extract(_first(F.col("alone")), f"({P.NUMBER})", 1)
    annex = F.col("title").rlike(P.ANNEX)
    rows = rows.withColumn("number", _number(F.coalesce(in_cell, F.when(~annex, F.coalesce(in_title, F.col("record.number"), in_line)))))

    by_number = F.lit(None).cast("string")
    for start, name in reversed(P.NUMBER_ISSUERS):
        by_number = F.when(F.col("number").rlike(f"^(?:{start})"), name).otherwise(by_number)
    every = "|".join(sorted((f for forms in P.ISSUERS.values() for f in forms), key=len, reverse=True))
    rest = lambda x: F.regexp_replace(x, f"{every}|{P.DATE}|{P.CHINESE_DATE}|{P.SIGNATURE_WORDS}", "")
    signed = F.filter(F.transform(ends, F.trim), lambda x: (F.length(x) <= 40) & ~x.rlike(P.CHROME) & ~F.contains(x, F.lit("《")) & x.rlike(every) & (rest(x) == ""))
    rows = rows.withColumn("signed", signed).withColumn("signature", _first(F.col("signed")))
    sources = {"title": named_issuer(F.col("title")), "metadata_table": named_issuer(F.col("issuer_cell")), "document_number": by_number, "signature": named_issuer(F.col("signature"))}
    rows = rows.withColumns({f"by_{n}": c for n, c in sources.items()})
    located = F.lit(None).cast("string")
    for n in reversed(sources):
        located = F.when(F.col(f"by_{n}").isNotNull(), n).otherwise(located)
    # The last date before the record says "published", unless it is that of a decision.
    dates = F.regexp_extract_all("record.before", F.lit(f"({P.DATE}[^年]*?)(?=\\d{{4}}\\s*年|$)"), F.lit(1))
    rows = rows.withColumn("dates", F.filter(dates, lambda d: ~d.rlike("审议|通过")))
    last = F.when(F.size("dates") > 0, F.element_at("dates", -1))
    part = lambda n: F.regexp_extract(last, P.DATE, n).try_cast("int")
    fine = part(1).between(1900, 2100)
    published = F.when(fine, F.try_to_date(F.format_string("%04d-%02d-%02d", part(1), part(2), part(3))))
    return rows.select(key, F.coalesce(*(F.col(f"by_{n}") for n in sources)).alias("issuer"), located.alias("located"), "number", published.alias("published"))


def completions(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, clause, place, said, act, own: what texts say was done, and as what.

    texts has the key, the text, and optionally role (condition or requirement),
    which its first clause is meant as. A clause that states nothing itself is what the one before is, where a conjunction joins them
    and that one is a condition or requirement; contrasts, consequences and ends of
    sentences end that. act is negated, requirement, condition or assertion; own marks what
    the speaker claims to have done. The key has to be unique.
    """
    role = F.col("role") if "role" in texts.columns else F.lit(None).cast("string")
    plain = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "[*_`]+", "")
    cut = F.split(F.regexp_replace(plain, f"({P.CLAUSE})", "\u0001$1\u0001"), "\u0001")
    parts = texts.select(F.col(key), F.coalesce(role, F.lit("assertion")).alias("role"), F.posexplode(cut).alias("n", "part"))
    along = Window.partitionBy(key).orderBy("n")
    # Parts of even number are clauses, those between them what parts them; blank clauses don't count.
    parts = parts.withColumn("breaks", (F.col("n") % 2 == 1) & F.col("part").rlike(P.SENTENCE)).withColumn("sentence", F.sum(F.col("breaks").cast("int")).over(along)).withColumn("before", F.lag("part").over(along))
    clauses = parts.where("n % 2 = 0").withColumn("part", F.trim("part")).where("part <> ''")
    bits = F.split(F.regexp_replace("part", f"({P.DONE})", "\u0002$1\u0002"), "\u0002")
    clauses = clauses.withColumn("bits", bits).withColumn("first", F.row_number().over(along) == 1).withColumn("joined", F.coalesce(F.col("before").isin(*P.CONJUNCTIONS), F.lit(False)) & ~F.col("first"))
    clauses = clauses.withColumn("chain", F.sum((~F.col("joined")).cast("int")).over(along))
    speaks = F.element_at("bits", 1).rlike(P.SPEAKER)
    clauses = clauses.withColumn("speaks", F.max(speaks.cast("int")).over(Window.partitionBy(key, "sentence").orderBy("n")) == 1)

    numbers = F.when(F.size("bits") > 2, F.sequence(F.lit(1), F.size("bits") - 2, F.lit(2)))
    found = clauses.select(key, "role", "n", "chain", "first", "speaks", "part", "bits", F.explode_outer(numbers).alias("i"))
    bit = lambda i: F.get("bits", i)
    prefix, said, tail = F.trim(bit(F.col("i") - 1)), bit(F.col("i")), F.array_join(F.slice("bits", F.col("i") + 2, F.size("bits")), "")
    after = F.regexp_extract(prefix, f"{P.DENIAL}(.*)$", 1)
    double = F.concat(prefix, said).rlike(P.DOUBLE_DENIAL)
    denied = prefix.rlike(P.DENIAL) & ~double & (F.length(after) <= 40) & ~after.rlike(P.UNDENIED)
    report = F.concat(prefix, said).rlike(P.REPORT)
    own = prefix.rlike(P.SPEAKER) | said.rlike("(?:已|已经)(?:为|替|帮)[你您]") | (F.col("speaks") & F.col("part").rlike("^(?:已经|业已|现已|确已|已)"))
    act = F.when(denied, "negated").when(double, "assertion").when((prefix.rlike(P.QUESTION) | prefix.rlike(P.REQUIREMENT)) & ~report, "requirement").when(own | report, "assertion").when(prefix.rlike(P.CONDITION) | tail.rlike(P.CONSEQUENCE), "condition")
    later = F.col("i") > 1
    found = found.withColumns({"act": F.when(F.col("i").isNotNull(), F.coalesce(act, F.when(later, "assertion"))), "own": own, "said": F.substring(F.regexp_replace(F.concat(said, F.coalesce(bit(F.col("i") + 1), F.lit(""))), "[。.;；!?！？]+$", ""), 1, 35)})
    # A clause carries on the last act of its chain of joined clauses; the text's role holds for the chain of the first clause.
    chain = Window.partitionBy(key, "chain").orderBy("n", "i")
    kept = F.last("act", True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.max(F.col("first").cast("int")).over(Window.partitionBy(key, "chain")) == 1
    inherited = F.coalesce(kept, F.when(opens, F.col("role")), F.lit("assertion"))
    inherited = F.when(F.col("first") | inherited.isin("condition", "requirement"), inherited).otherwise("assertion")
    return found.withColumn("act", F.coalesce("act", inherited)).where("i is not null").select(key, (F.col("n") / 2).cast("int").alias("clause"), ((F.col("i") - 1) / 2).cast("int").alias("place"), "said", "act", "own")


def unverified(answers: DataFrame, support: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, said: what answers assert to be done although no supporting text of theirs asserts it; what the speaker claims to have done never is supported.

    Each has unique keys; a source that requires or denies something is no support for it.
    """
    claims = completions(answers, key).where("act = 'assertion'").select(key, "said", "own")
    known = completions(support, key).where("act = 'assertion'").groupBy(key).agg(F.collect_set("said").alias("known"))
    rows = claims.join(known, key, "left")
    held = F.coalesce(F.exists("known", lambda k: F.contains(k, F.col("said"))), F.lit(False))
    return rows.where(F.col("own") | ~held).select(key, "said").distinct()


_LOCATOR = "ordinal long, step_index long, step_no long, line_start long, source_char_start long, label string, node_path string, part string, source_page long, coordinate_space string, bbox array<double>"


def step_order(steps: DataFrame) -> DataFrame:
    """version_id, block_id, position (from 1; null if the source doesn't tell): the order of a procedure's steps.

    steps: version_id, block_id, ordinal, locator (JSON). The first that all steps
    of a version have, each another one, gives the order: the ordinal, a
    counter or place of the locator, the number in its label, its path in one part,
    its page, its place on the page. Ordinals that all have but some share tell
    nothing. Neither the order of rows nor ids do.
    """
    at = F.from_json("locator", _LOCATOR)
    padded = lambda c: F.when(c >= 0, F.lpad(c.cast("string"), 20, "0"))
    label = F.regexp_extract_all("at.label", F.lit("(?i)(?:步骤|step)\\s*(\\d+)|第\\s*(\\d+)\\s*步"), F.lit(0))
    digits = F.regexp_extract(_first(label), "(\\d+)", 1)
    runs = F.regexp_extract_all("at.node_path", F.lit("(\\d+|\\D+)"), F.lit(1))
    path = F.when(F.col("at.node_path") != "", F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^\\d"), F.concat(F.lit("1"), F.lpad(r, 20, "0"))).otherwise(F.concat(F.lit("0"), r))), "\u0001"))
    place = lambda n: F.format_string("%030.6f", F.col("at.bbox")[n] + F.lit(1e9))
    boxed = F.col("at.coordinate_space").isin("top_left_points", "top_left_pixels") & (F.size("at.bbox") == 4) & ~F.exists("at.bbox", F.isnull)
    keys = {
        "ordinal": padded(F.col("ordinal")), **{n: padded(F.col(f"at.{n}")) for n in ("step_index", "step_no", "line_start", "source_char_start")}, "label": padded(F.nullif(digits, F.lit("")).try_cast("long")), "path": path, "page": padded(F.col("at.source_page")),
        "box": F.when(boxed, F.concat_ws("|", padded(F.col("at.source_page")), place(1), place(0))),
    }
    keys = {"ordinal": keys.pop("ordinal"), "inner": padded(F.col("at.ordinal")), **keys}
    rows = steps.select("version_id", "block_id", "ordinal", at.alias("at")).select("version_id", "block_id", F.col("at.part").alias("part"), F.col("at.coordinate_space").alias("space"), *(k.alias(f"by_{n}") for n, k in keys.items()))
    of = Window.partitionBy("version_id")
    same = lambda c: F.size(F.collect_set(F.coalesce(c, F.lit(""))).over(of)) == 1
    told = {n: (F.count(f"by_{n}").over(of) == F.count("*").over(of)) & (F.size(F.collect_set(f"by_{n}").over(of)) == F.count("*").over(of)) for n in keys}
    told["path"] &= same(F.col("part"))
    told["box"] &= same(F.col("space"))
    shared = (F.count("by_ordinal").over(of) == F.count("*").over(of)) & ~told["ordinal"]
    chosen = F.lit(None).cast("string")
    for n in reversed(keys):
        chosen = F.when(told[n], F.col(f"by_{n}")).otherwise(chosen)
    chosen = F.when(F.count("*").over(of) == 1, F.lit("")).when(shared, F.lit(None)).otherwise(chosen)
    rows = rows.select("version_id", "block_id", chosen.alias("chosen"))
    position = F.row_number().over(Window.partitionBy("version_id").orderBy("chosen"))
    return rows.select("version_id", "block_id", F.when(F.col("chosen").isNotNull(), position).alias("position"))

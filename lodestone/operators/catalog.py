"""Catalogue: filters, access, taxonomy, versions, applicability, pagination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import ancestors

ROLES = ("reader", "editor", "reviewer", "publisher", "admin")


def in_subtree(path: Column, top: str) -> Column:
    """The path itself or anything below it."""
    return (path == top) | F.startswith(path, F.lit(top + "/"))


def resource_filter(kind: str | None = None, category: str | None = None, tag: str | None = None, text: str | None = None, trash: bool = False) -> Column:
    """List filter over kind, category (subtree), tags, name and deleted_at; unset parts don't filter."""
    parts = [F.col("deleted_at").isNotNull() if trash else F.col("deleted_at").isNull()]
    if kind is not None:
        parts.append(F.col("kind") == kind)
    if category is not None:
        parts.append(in_subtree(F.col("category"), category))
    if tag is not None:
        parts.append(F.array_contains("tags", tag))
    if text is not None:
        parts.append(F.contains(F.lower("name"), F.lit(text.lower())))
    return reduce(lambda a, b: a & b, parts)


def rename_subtree(path: Column, old: str, new: str) -> Column:
    """The path with a prefix of whole levels replaced."""
    return F.when(in_subtree(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def effective_roles(users: DataFrame, spaces: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, space_id, roles (sorted).

    A personal space gives its owner all roles and nobody else any; a team space
    adds reader to the explicit roles of every active user; inactive users have none.
    """
    active = users.where("active").select("user_id")
    explicit = members.join(active, "user_id", "left_semi").groupBy("user_id", "space_id").agg(F.collect_set("role").alias("explicit"))
    personal = spaces.where("kind = 'personal'").join(active, F.col("owner_id") == F.col("user_id")).select("user_id", "space_id", F.array(*map(F.lit, ROLES)).alias("roles"))
    shared = explicit.join(spaces.where("kind <> 'personal'").select("space_id", "kind"), "space_id")
    shared = shared.select("user_id", "space_id", F.when(F.col("kind") == "team", F.array_union("explicit", F.array(F.lit("reader")))).otherwise(F.col("explicit")).alias("roles"))
    return personal.unionByName(shared).select("user_id", "space_id", F.sort_array("roles").alias("roles"))


def readable(resources: DataFrame, roles: DataFrame, grants: DataFrame, permission: str = "read") -> DataFrame:
    """user_id with the columns of every resource the user may read.

    Any role in the space admits to open resources; restricted ones need a grant
    too. Without roles nothing is returned.
    """
    inside = resources.where("deleted_at is null").join(roles.where(F.size("roles") > 0).select("user_id", "space_id"), "space_id")
    granted = grants.where(F.col("permission") == permission).select("user_id", "resource_id").distinct()
    open_ones = inside.where("not restricted")
    closed = inside.where("restricted").join(granted, ["user_id", "resource_id"], "left_semi")
    return open_ones.unionByName(closed)


def permits(roles: Column, grants: Column, restricted: Column) -> Column:
    """Struct of the actions that roles and grants allow on a resource."""
    has = lambda r: F.array_contains(roles, r)
    return F.struct(
        (F.size(roles) > 0).alias("read"), ((F.size(roles) > 0) & (~restricted | F.array_contains(grants, "download"))).alias("download"), has("editor").alias("edit"), has("reviewer").alias("review"),
        has("publisher").alias("publish"), (has("admin") | ((has("editor") | has("publisher")) & F.array_contains(grants, "manage"))).alias("manage"),
    )


def version_readable(roles: Column, released: Column, state: Column, is_author: Column, team: Column) -> Column:
    """Whether a version may be read: released ones by all, others by reviewers, publishers and editors of their own or of team drafts."""
    inside = F.array_contains(roles, "reviewer") | F.array_contains(roles, "publisher")
    drafts = F.array_contains(roles, "editor") & (is_author | ((state == "DRAFT") & team))
    return released | inside | drafts


def visible_version(released: DataFrame, current: DataFrame, drafts: DataFrame, resource: str = "resource_id", number: str = "version_no") -> DataFrame:
    """resource, version: the active release, else the version that holds now, else the newest draft; each frame has one row per resource."""
    side = lambda df, name: df.select(resource, F.col(number).alias(name))
    rows = side(released, "a").join(side(current, "b"), resource, "full").join(side(drafts, "c"), resource, "full")
    return rows.select(resource, F.coalesce("a", "b", "c").alias(number))


def taxonomy(rows: DataFrame, path: str = "path", registered: DataFrame | None = None) -> DataFrame:
    """path, n (rows at or below), n_direct: every row counts into all its ancestors; registered paths without rows count 0."""
    direct = rows.groupBy(path).agg(F.count("*").alias("k"))
    spread = direct.select(F.explode(ancestors(F.col(path))).alias("up"), F.col(path).alias("own"), "k")
    out = spread.groupBy(F.col("up").alias("path")).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("up") == F.col("own"), F.col("k")).otherwise(0)).alias("n_direct"))
    if registered is None:
        return out
    return out.join(registered.select("path").distinct(), "path", "full").select("path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"))


def tag_counts(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """tag, n: rows per distinct tag, without aliases."""
    found = rows.select(F.explode(F.array_distinct(tags)).alias("tag")).where(~F.startswith("tag", F.lit("alias:")))
    return found.groupBy("tag").agg(F.count("*").alias("n"))


def keyset_page(rows: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The next `limit` rows in descending order of the keys after an anchor, and whether more follow."""
    if after is not None:
        rows = rows.where(F.struct(*keys) < F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after))))
    page = rows.orderBy(*(F.col(k).desc() for k in keys)).limit(limit + 1)
    order = Window.orderBy(*(F.col(k).desc() for k in keys))  # over at most limit + 1 rows
    numbered = page.withColumn("place", F.row_number().over(order).cast("long"))
    return numbered.withColumn("has_more", F.max("place").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("place") <= limit)


def latest(versions: DataFrame, resource: str = "resource_id", number: str = "version_no") -> DataFrame:
    """The row of the greatest version number of each resource."""
    fields = [c for c in versions.columns if c not in (resource, number)]
    best = versions.groupBy(resource).agg(F.max_by(F.struct(number, *fields), number).alias("v"))
    return best.select(resource, "v.*")


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """start <= day < end, either side open when null."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day < end))


def applicable(terms: Column, context: Column) -> Column:
    """Three-valued: false if a term fails, else null if a needed context value is missing or empty, else true.

    terms: array of (group 'all' or 'none', field, values). context: map of strings.
    """

    def holds(t: Column) -> Column:
        value = F.element_at(context, t["field"])
        known = F.when(value != "", F.array_contains(t["values"], value))
        return F.when(t["group"] == "none", ~known).otherwise(known)

    return F.forall(terms, holds)


def as_of(versions: DataFrame, day: Column, resource: str = "resource_id", number: str = "version_no") -> DataFrame:
    """The version of each resource that holds on a day, or none.

    Of the approved, released versions that have started and do not definitely
    fail to apply, the newest decides: it is returned if it has not ended, its
    applicability is known, its legal status is clear and its hash holds.
    Otherwise the resource has no row; older versions never step in.
    versions: state, released, valid_from, valid_to, applicable (three-valued),
    legal_status, verified, hash_ok.
    """
    live = versions.where((F.col("state") == "APPROVED") & F.col("released") & (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & F.coalesce(F.col("applicable"), F.lit(True)))
    newest = latest(live, resource, number)
    clear = ~F.col("legal_status").isin("UNKNOWN", "PARTIAL") & ~((F.col("legal_status") == "FUTURE") & F.col("valid_from").isNull()) & ~((F.col("legal_status") == "REPEALED") & F.col("valid_to").isNull())
    return newest.where((F.col("valid_to").isNull() | (day < F.col("valid_to"))) & F.col("applicable") & clear & F.col("verified") & F.col("hash_ok"))


def first_reason(reasons: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The code of the first condition that holds; a null condition doesn't."""
    out = F.lit(otherwise)
    for condition, code in reversed(reasons):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def effective_day(day: Column, instant: Column) -> Column:
    """An explicit day, or the date of an instant eight hours east of Greenwich."""
    return F.coalesce(day, F.to_date(F.from_utc_timestamp(instant, "+08:00")))


def duplicates_of_key(rows: DataFrame, *key: str) -> DataFrame:
    """Violations of uniqueness over keys without nulls: key, n."""
    filled = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return rows.where(filled).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def purgeable(resources: DataFrame, day: Column, days: int) -> DataFrame:
    """resource columns with expiry, reasons (codes that stand against a purge) and eligible."""
    expiry = F.greatest("retain_until", F.date_add("deleted_on", days))
    reasons = F.array_compact(F.array(
        F.when(F.col("deleted_on").isNull(), "TRASH_REQUIRED"), F.when(F.col("legal_hold"), "LEGAL_HOLD"), F.when(day < F.col("expiry"), "RETENTION_NOT_EXPIRED"), F.when(F.col("n_dependents") > 0, "DEPENDENCY_EXISTS"),
    ))
    return resources.withColumn("expiry", expiry).withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)

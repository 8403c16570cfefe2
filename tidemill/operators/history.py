"""Version histories: capture, validity intervals, and as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import UNKNOWN, beginning_of_time, end_of_time, or_unknown, strict_greatest, surrogate_key, version_key
from tidemill.operators.dims import Dimension, surrogate_key_or_null

#: The columns of each member table whose change makes a new version.
CHECKED = {
    "advertiser": ("advertiser_name", "industry", "billing_country", "billing_currency", "account_status", "is_deleted"),
    "campaign": (
        "campaign_name", "campaign_objective", "campaign_status", "campaign_budget", "daily_budget", "start_date", "end_date",
        "bid_strategy", "is_deleted",
    ),
    "line_item": (
        "line_item_name", "line_item_status", "bid_amount", "bid_currency", "optimization_goal", "target_cpm", "frequency_cap",
        "start_date", "end_date", "is_deleted",
    ),
    "creative": ("creative_name", "creative_type", "creative_format", "landing_page_url", "creative_status", "is_deleted"),
    "publisher": ("publisher_name", "publisher_type", "country", "domain", "publisher_status", "is_deleted"),
    "placement": ("placement_name", "placement_type", "ad_format", "floor_price", "currency", "device_type", "is_deleted"),
    "audience": ("audience_name", "audience_type", "min_age", "max_age", "gender", "country", "interest_category", "is_deleted"),
}


def capture_versions(log: DataFrame, pk: str, order: list[str], checked: list[str]) -> DataFrame:
    """Rows of a log at which a checked column differs from the row before."""
    w = Window.partitionBy(pk).orderBy(*order)
    # A null leaves a hash as it was, so whether there is one is hashed too.
    state = F.xxhash64(*[x for c in checked for x in (F.col(c), F.col(c).isNull())])
    marked = log.withColumn("_state", state).withColumn("_before", F.lag("_state").over(w))
    return marked.where(F.col("_before").isNull() | (F.col("_before") != F.col("_state"))).drop("_state", "_before")


def type2(versions: DataFrame, pk: str, at: str, created_at: str, tie: str | None = None, name: str = "entity") -> DataFrame:
    """Half-open validity [valid_from, valid_to), current flag and version key.

    Times that run backwards are clamped to the running maximum; the first version starts at creation if
    that is earlier; ties give versions of no length, which no as-of join meets.
    """
    order = [at, tie] if tie else [at]
    w = Window.partitionBy(pk).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clamped = versions.withColumn("_at", F.max(at).over(upto))
    first = F.row_number().over(w) == 1
    start = F.when(first & F.col(created_at).isNotNull(), F.least(F.col(created_at), F.col("_at"))).otherwise(F.col("_at"))
    dated = clamped.withColumn("valid_from", start)
    following = F.lead("valid_from").over(w)
    natural = F.concat_ws("|", F.col(pk).cast("string"), *([F.col(tie).cast("string")] if tie else []))
    return (
        dated.withColumn("valid_to", F.coalesce(following, end_of_time().cast(dict(versions.dtypes)[at])))
        .withColumn("is_current", following.isNull())
        .withColumn(f"{name}_version_key", version_key(natural, F.col(at)))
        .drop("_at")
    )


def version_times(updated_at: str, deleted_at: str):
    """When a version began: its update, or its deletion if that came later."""
    both = strict_greatest(F.col(updated_at), F.col(deleted_at))
    return F.coalesce(both, F.col(updated_at))


def member_versions(captures: DataFrame, dim: Dimension, checked: tuple[str, ...] | None = None) -> DataFrame:
    """The versions of a member table from the whole log of its captures: their columns, when each began, its
    validity, and whether it is in force and the member's last.

    Captures hold the table's columns, is_deleted, deleted_at, created_at, updated_at and captured_at. Versions
    are in the order of their capture; when one began is its update or deletion, clamped to the running maximum.
    """
    checked = checked or CHECKED[dim.name]
    pk = dim.natural_key
    w = Window.partitionBy(pk).orderBy("captured_at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    versions = capture_versions(captures, pk, ["captured_at"], list(checked))
    timed = versions.withColumn("began_at", F.max(version_times("updated_at", "deleted_at")).over(upto))
    following, first = F.lead("began_at").over(w), F.row_number().over(w) == 1
    ends = end_of_time().cast(timed.schema["began_at"].dataType)
    start = F.when(first & F.col("created_at").isNotNull(), F.least("created_at", "began_at")).otherwise(F.col("began_at"))
    return timed.withColumns(
        {"valid_from": start, "valid_to": F.coalesce(following, ends), "is_current": following.isNull(), "is_last": following.isNull()}
    )


def grow_versions(
    versions: DataFrame | None, snapshot: DataFrame, dim: Dimension, at: Column, checked: tuple[str, ...] | None = None, close_absent: bool = True
) -> DataFrame:
    """``member_versions`` after one more snapshot, from the versions before it; ``at`` is the snapshot's time.

    A member with a changed column gets a new version, which ends the one before. One that the snapshot lacks
    is closed at that time, or left as it is; if it comes back it gets a version from its update on, not before it
    was closed. The same snapshot again changes nothing. Only members' last versions are joined.
    """
    checked = checked or CHECKED[dim.name]
    pk = dim.natural_key
    time = version_times("updated_at", "deleted_at")
    if versions is None:
        return member_versions(snapshot, dim, checked)
    names, kind = versions.columns, versions.schema["began_at"].dataType
    o, n = (lambda c: F.col(f"_o_{c}")), (lambda c: F.col(f"_n_{c}"))
    last = versions.where("is_last").select(*[F.col(c).alias(f"_o_{c}") for c in names])
    both = last.join(snapshot.select(*[F.col(c).alias(f"_n_{c}") for c in snapshot.columns], time.alias("_time")), o(pk) == n(pk), "full_outer")
    known, found = o(pk).isNotNull(), n(pk).isNotNull()
    same = reduce(lambda x, y: x & y, [o(c).eqNullSafe(n(c)) for c in checked]) & o("is_current")
    # The rows that each pair gives: the version before, a new one, or both. An array of whole rows without its nulls would say
    # so in one step, but Spark interprets what array functions with a condition are given.
    marked = both.withColumn("_changed", found & (~known | ~same))
    changed, old, new = F.col("_changed"), F.array(F.lit(False)), F.array(F.lit(True))
    rows = marked.select("*", F.explode(F.when(known & changed, F.array(F.lit(False), F.lit(True))).when(known, old).when(changed, new)).alias("_new"))
    # When it was closed holds for a member that is back; a member's versions do not run backwards.
    since = F.when(~o("is_current"), F.greatest(o("valid_to"), o("began_at"))).otherwise(o("began_at"))
    began = F.greatest(F.coalesce(since, F.col("_time")), F.col("_time")).cast(kind)
    start = F.when(~known & n("created_at").isNotNull(), F.least(n("created_at"), F.col("_time"))).otherwise(began)
    closed = F.greatest(o("began_at"), at.cast(kind))
    absent = known & ~found & o("is_current") & F.lit(close_absent)
    ended = {
        "valid_to": F.when(absent, closed).when(changed & o("is_current"), began).otherwise(o("valid_to")),
        "is_current": o("is_current") & ~absent & ~changed,
        "is_last": ~changed,
    }
    made = {"began_at": began, "valid_from": start, "valid_to": end_of_time().cast(kind), "is_current": F.lit(True), "is_last": F.lit(True)}
    before = lambda c: ended.get(c, o(c))
    after = lambda c: made.get(c, n(c) if c in snapshot.columns else F.lit(None)).cast(versions.schema[c].dataType)
    return versions.where("NOT is_last").unionByName(rows.select(*[F.when(F.col("_new"), after(c)).otherwise(before(c)).alias(c) for c in names]))


def shape_history(versions: DataFrame, dim: Dimension, checked: tuple[str, ...] | None = None) -> DataFrame:
    """The Type 2 history of ``member_versions``, with one unknown version for all time. The key comes from the
    capture, since two versions may begin at one time."""
    checked = checked or CHECKED[dim.name]
    pk = dim.natural_key
    rows = versions.select(
        version_key(F.col(pk), F.col("captured_at")).alias(f"{dim.name}_version_key"),
        surrogate_key(F.col(pk)).alias(dim.key),
        pk,
        *[or_unknown(surrogate_key_or_null(natural)).alias(out) for out, natural in dim.parents.items()],
        *[c for c in checked if c != pk],
        "valid_from",
        "valid_to",
        "is_current",
        "captured_at",
    )
    kinds = dict(rows.dtypes)
    fixed = {"valid_from": beginning_of_time(), "valid_to": end_of_time(), "is_current": F.lit(True), "is_deleted": F.lit(False)}
    fixed |= {c: F.lit(UNKNOWN) for c in (f"{dim.name}_version_key", dim.key, *dim.parents)}
    blank = lambda c: F.lit(dim.unknown.get(c, "Unknown" if kinds[c] == "string" and c != pk else None))
    one = versions.sparkSession.range(1).select(*[(fixed[c] if c in fixed else blank(c)).cast(kinds[c]).alias(c) for c in rows.columns])
    return rows.unionByName(one)


def entity_history(captures: DataFrame, dim: Dimension, checked: tuple[str, ...] | None = None) -> DataFrame:
    """The Type 2 history of a member table from the whole log of its captures."""
    return shape_history(member_versions(captures, dim, checked), dim, checked)


def as_of_join(facts: DataFrame, history: DataFrame, key: str, ts: str, version_col: str, out: str) -> DataFrame:
    """Adds the version of ``key`` in force at ``ts``, UNKNOWN if none. Equality keeps it a hash or merge join."""
    return as_of_time(facts, history, key, ts, version_col, out).withColumn(out, or_unknown(F.col(out)))


def as_of_time(facts: DataFrame, history: DataFrame, key: str, ts: str, version_col: str, out: str) -> DataFrame:
    """As ``as_of_join``, null if no version is in force."""
    h = history.select(
        F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col(version_col).alias("_version")
    )
    on = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))
    return facts.join(h, on, "left").withColumn(out, F.col("_version")).drop("_key", "_from", "_to", "_version")


#: A key with more than one in so many rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000


def hot_keys(facts: DataFrame, key: str) -> DataFrame:
    """(key, salts): keys of more than one row in HOT_SHARE, and over how many salts to spread each."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    most = (counts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    return counts.where((F.col("n") > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / max(most, 1)).cast("int").alias("salts"))


def as_of_merge(facts: DataFrame, history: DataFrame, key: str, ts: str, version_col: str, out: str, hot: DataFrame | None = None) -> DataFrame:
    """``as_of_join`` as one sorted pass over facts and versions together, for keys with very many versions: each
    fact takes the last version that began at or before it, if that has not ended.

    Facts of ``hot`` keys, as ``hot_keys`` finds them, are spread over salts and their versions repeated for each.
    """
    salt, salted = F.lit(0), F.lit(1)
    v = history.select(
        F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.col("valid_to").alias("_to"), F.col(version_col).alias("_version")
    )
    if hot is not None:
        few = F.broadcast(hot.select(F.col(key).alias("_hot"), "salts"))  # fewer than HOT_SHARE rows
        facts_ = facts.join(few, F.col(key) == F.col("_hot"), "left")
        v = v.join(few, F.col("_key") == F.col("_hot"), "left").drop("_hot")
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
        salted = F.coalesce("salts", F.lit(1))
    else:
        facts_ = facts
    whole = F.struct(*facts.columns)
    events = facts_.select(F.col(key).alias("_key"), salt.alias("_salt"), F.col(ts).alias("_at"), whole.alias("_fact"))
    starts = v.select("_key", F.explode(F.sequence(F.lit(0), salted - 1)).alias("_salt"), "_at", F.struct("_to", "_version").alias("_in"))
    both = events.withColumn("_in", F.lit(None).cast(starts.schema["_in"].dataType)).unionByName(
        starts.withColumn("_at", F.col("_at").cast(events.schema["_at"].dataType)).withColumn("_fact", F.lit(None).cast(events.schema["_fact"].dataType))
    )
    # Of versions that begin together the one that ends last is in force; it comes last before the facts of its time.
    order = [F.col("_at").asc_nulls_first(), F.col("_fact").isNotNull(), F.col("_in._to").asc_nulls_first()]
    w = Window.partitionBy("_key", "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_in", ignorenulls=True).over(w)).where(F.col("_fact").isNotNull())
    inside = (F.col("_at") < F.col("_last._to")) & F.col("_key").isNotNull() & F.col("_at").isNotNull()
    return found.select("_fact.*", or_unknown(F.when(inside, F.col("_last._version"))).alias(out))


def not_contiguous(history: DataFrame, pk: str, tie: str | None = None) -> DataFrame:
    """Versions whose end is not the start of the next one."""
    w = Window.partitionBy(pk).orderBy("valid_from", "valid_to", *([tie] if tie else []))
    return history.withColumn("_next", F.lead("valid_from").over(w)).where(
        F.col("_next").isNotNull() & (F.col("_next") != F.col("valid_to"))
    )


def not_one_current(history: DataFrame, pk: str) -> DataFrame:
    return history.groupBy(pk).agg(F.count_if("is_current").alias("n_current")).where(F.col("n_current") != 1)

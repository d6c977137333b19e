"""Merges of incoming rows into a stored relation: a new snapshot from the current one and the changes.

Each takes DataFrames with the same columns and gives the next snapshot; the caller writes it as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the delta win; keys are unique in it."""
    return current.join(delta.select(*key), key, "left_anti").unionByName(delta)


def insert_absent(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Only rows of new keys are added."""
    return current.unionByName(delta.join(current.select(*key), key, "left_anti"))


def merge(current: DataFrame, delta: DataFrame, key: list[str], rules: dict[str, str] | None = None, protect: Column | None = None, protected: tuple[str, ...] = ()) -> DataFrame:
    """A full outer merge. rules by column: 'new' (default), 'keep' (new unless null), 'fill' (old unless null or empty).

    Where `protect` holds on the current row, the protected columns keep their old values whatever the rule. Columns that the delta
    lacks keep their old values. Rows that only one side has are taken as they are.
    """
    rules = rules or {}
    old, new = current.withColumn("_old", F.lit(True)), delta.withColumn("_new", F.lit(True))
    if protect is not None:
        old = old.withColumn("_safe", F.coalesce(protect, F.lit(False)))
    names = [c for c in current.columns if c not in key]
    old = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in names), "_old", *(["_safe"] if protect is not None else []))
    new = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in names if c in delta.columns), "_new")
    joined = old.join(new, key, "full_outer")
    out = []
    for c in names:
        o = F.col(f"o_{c}")
        if c not in delta.columns:
            out.append(o.alias(c))
            continue
        n = F.col(f"n_{c}")
        value = {"new": n, "keep": F.coalesce(n, o), "fill": F.coalesce(F.when(o.cast("string") != "", o), n)}[rules.get(c, "new")]
        value = F.when(F.col("_new").isNull(), o).when(F.col("_old").isNull(), n).otherwise(value)
        if protect is not None and c in protected:
            value = F.when(F.coalesce(F.col("_safe"), F.lit(False)), o).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*key, *out)


def expire(current: DataFrame, rejected: DataFrame, accepted: DataFrame, key: str, today: Column, expires: str = "expires") -> DataFrame:
    """status after a run: rejected keys go to 'expired' or 'review' by their reason, unless the run accepted the key too; then what is past its date expires."""
    worst = rejected.join(accepted.select(key), key, "left_anti").groupBy(key).agg(F.min(F.when(F.col("reason").startswith("gone"), "expired").otherwise("review")).alias("_s"))
    joined = current.join(worst, key, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    return joined.withColumn("status", F.when((F.col("status") == "live") & (F.col(expires) < today), "expired").otherwise(F.col("status")))


def retained(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Rows that are not older than the cutoff; rows without a date stay."""
    return rows.where(F.coalesce(F.col(at) >= cutoff, F.lit(True)))


def refresh_seen(activities: DataFrame, checks: DataFrame) -> DataFrame:
    """last_seen of activities moves to their source's check only if that succeeded, found the content unchanged and has no error.

    activities: id, source, last_seen; checks: source, checked, ok, hash, old_hash, error.
    """
    good = checks.where(F.col("ok") & F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("hash").isNotNull() & F.col("error").isNull()).groupBy("source").agg(F.max("checked").alias("_checked"))
    return activities.join(good, "source", "left").withColumn("last_seen", F.greatest("last_seen", "_checked")).drop("_checked")


def claim_slots(claimed: DataFrame, wanted: DataFrame, key: list[str], order: str) -> DataFrame:
    """wanted with `state`: 'claimed' for the first of a free slot, 'already' otherwise."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    marked = wanted.withColumn("_n", n).join(claimed.select(*key).distinct().withColumn("_taken", F.lit(True)), key, "left")
    return marked.withColumn("state", F.when(F.col("_taken").isNull() & (F.col("_n") == 1), "claimed").otherwise("already")).drop("_n", "_taken")


def fingerprint(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row: md5 over all rows' digests in order of a key, and their number.

    Digests are gathered by range of the key and each range is hashed before the ranges are, so that no value holds all rows' contents.
    """
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    parts = rows.select(F.col(order).alias("k"), digest.alias("d"), F.floor(F.col(order) / 1024).alias("part"))
    hashed = parts.groupBy("part").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("k", "d")))["d"], "")).alias("h"), F.count(F.lit(1)).alias("n"))
    return hashed.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("part", "h")))["h"], "")).alias("fingerprint"), F.sum("n").alias("n"))


def difference(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, change, fields: rows that were added, are missing, or differ, with the names of the columns that do."""
    a = before.select(*key, F.struct(*columns).alias("a"))
    b = after.select(*key, F.struct(*columns).alias("b"))
    fields = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)), lambda f: f.isNotNull())
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed")
    both = a.join(b, key, "full_outer").select(*key, change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), fields).otherwise(F.array().cast("array<string>")).alias("fields"))
    return both.where((F.col("change") != "changed") | (F.size("fields") > 0))


def assert_count(rows: DataFrame, expected: int) -> DataFrame:
    """rows, if there are as many as expected; raises otherwise, before anything is written."""
    found = rows.count()
    if found != expected:
        raise ValueError(f"{found} rows where {expected} were expected")
    return rows


def apply_plan(current: DataFrame, plan: DataFrame, key: str, column: str) -> DataFrame:
    """current with the plan's values where its fingerprint still fits: `applied` tells which rows changed, 'stale' which no longer fit.

    plan: key, expected (md5 of the row as it was), value.
    """
    state = F.md5(F.to_json(F.struct(*sorted(c for c in current.columns))))
    joined = current.withColumn("_state", state).join(plan.select(key, "expected", "value"), key, "left")
    fits = F.col("expected") == F.col("_state")
    joined = joined.withColumn("applied", F.when(F.col("expected").isNull(), "none").when(fits, "applied").otherwise("stale"))
    return joined.withColumn(column, F.when(F.col("applied") == "applied", F.col("value")).otherwise(F.col(column))).drop("_state", "expected", "value")

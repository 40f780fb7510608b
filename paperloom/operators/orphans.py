"""Problem 2: references to records that do not exist, direct ones and those that inherit it.

A parent table says when each key is held: every row holds its key from ``loaded_at`` up to but excluding
``withdrawn_at``. A reference at a time at which its key is not held is an orphan, with a reason: ``missing`` (the key
has no row at all), ``deleted`` (it has rows loaded by then, all withdrawn) or ``late`` (all its rows are loaded later).

Method: fixpoint cascade. The direct orphans are the first frontier; a key that only orphaned records provide is gone,
records that refer to a gone key are orphans by inheritance, and semi-joins down the foreign-key graph are repeated until
a round finds nothing new. A record that is both counts as direct.

Busy keys: states are carried per (key, day), so no task sees all rows of a key. Only days on which a key both changes
and is referred to need an order within the day; those are put in order per (key, day, salt), with the few changes
copied to every salt.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.skew import ROWS_PER_SALT, salted_join, salts_for
from paperloom.session import materialize

# Fixed value: stands for the day of a reference without a time; before any load.
NO_DAY = "0001-01-01"


def docket_number(c: Column) -> Column:
    """A docket id as a number: surrounding blanks and leading zeros do not count; null, blank and non-numbers give null."""
    text = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long"))


def references(df: DataFrame, table_name: str, row_id: str, key: Column, at: Column) -> DataFrame:
    """(table_name, row_id, key, at), one row per ``row_id``: of rows delivered repeatedly the latest, ties by key."""
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), key.alias("key"), at.cast("timestamp").alias("at"))
    one = rows.groupBy("row_id").agg(F.max(F.struct("at", "key")).alias("v"))
    return one.select(F.lit(table_name).alias("table_name"), "row_id", F.col("v.key").alias("key"), F.col("v.at").alias("at"))


def held_states(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``refs`` with ``loads`` (rows of the key loaded by then), ``held`` (rows holding it then) and ``ever`` (rows at all).

    ``parents`` has key, loaded_at, withdrawn_at; rows without key or load time hold nothing; a row withdrawn at or
    before its load counts as loaded only. References without a key are left out: they refer to nothing.
    """
    rows = parents.where(F.col("key").isNotNull() & F.col("loaded_at").isNotNull()).select("key", F.col("loaded_at").cast("timestamp").alias("a"), F.col("withdrawn_at").cast("timestamp").alias("b")).distinct()
    holds = F.col("b").isNull() | (F.col("b") > F.col("a"))
    changes = rows.select("key", F.col("a").alias("at"), F.when(holds, 1).otherwise(0).alias("held"), F.lit(1).alias("loads")).unionByName(
        rows.where(F.col("b").isNotNull() & holds).select("key", F.col("b").alias("at"), F.lit(-1).alias("held"), F.lit(0).alias("loads"))
    )
    day = F.to_date("at")
    changes = changes.withColumn("day", day)
    asked = refs.where(F.col("key").isNotNull()).withColumn("day", F.coalesce(day, F.to_date(F.lit(NO_DAY))))
    days = changes.groupBy("key", "day").agg(F.sum("held").alias("held"), F.sum("loads").alias("loads"), F.count("*").alias("n_changes"), F.lit(0).cast("long").alias("n_refs")).unionByName(
        asked.groupBy("key", "day").agg(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("loads"), F.lit(0).cast("long").alias("n_changes"), F.count("*").alias("n_refs"))
    )
    days = materialize(days.groupBy("key", "day").agg(*(F.sum(c).alias(c) for c in ("held", "loads", "n_changes", "n_refs"))), "orphan-days")
    # one row per key and day: as many as there are days
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    states = days.select(
        "key",
        "day",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("held_before"),
        F.coalesce(F.sum("loads").over(before), F.lit(0)).alias("loads_before"),
        F.sum("loads").over(Window.partitionBy("key")).alias("ever"),
        (F.col("n_changes") > 0).alias("changes_today"),
        F.ceil(F.col("n_refs") / F.lit(ROWS_PER_SALT)).cast("int").alias("salts"),
    )
    known = salted_join(asked, states.where("salts > 0"), ["key", "day"], salts=salts_for(days, ["key", "day"], "n_refs", ROWS_PER_SALT))
    columns = ["table_name", "row_id", "key", "at", "held", "loads", "ever"]
    quiet = known.where(~F.col("changes_today")).withColumns({"held": F.col("held_before"), "loads": F.col("loads_before")}).select(*columns)
    busy = known.where("changes_today").withColumn("salt", F.pmod(F.xxhash64("table_name", "row_id"), F.col("salts")).cast("int"))
    copied = changes.join(states.where("salts > 0 and changes_today").select("key", "day", "salts"), ["key", "day"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None)
    line = busy.select("key", "day", "salt", "at", F.lit(1).alias("is_ref"), F.lit(0).alias("d_held"), F.lit(0).alias("d_loads"), "table_name", "row_id", "held_before", "loads_before", "ever").unionByName(
        copied.select("key", "day", "salt", "at", F.lit(0).alias("is_ref"), F.col("held").alias("d_held"), F.col("loads").alias("d_loads"), none.cast("string").alias("table_name"), none.cast("long").alias("row_id"), none.cast("long").alias("held_before"), none.cast("long").alias("loads_before"), none.cast("long").alias("ever"))
    )
    # changes at the moment of a reference come first: loaded_at counts as held, withdrawn_at no longer
    within = Window.partitionBy("key", "day", "salt").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    ordered = line.withColumns({"held": F.sum("d_held").over(within) + F.col("held_before"), "loads": F.sum("d_loads").over(within) + F.col("loads_before")})
    return quiet.unionByName(ordered.where("is_ref = 1").select(*columns))


def direct_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(table_name, row_id, at, reason) of the references that are not held at their time.

    A reference without a time is an orphan only if its key has no row at all.
    """
    states = held_states(refs, parents)
    reason = F.when(F.col("ever") == 0, "missing").when(F.col("at").isNull() | (F.col("held") > 0), None).when(F.col("loads") > 0, "deleted").otherwise("late")
    return states.select("table_name", "row_id", "at", reason.alias("reason")).where(F.col("reason").isNotNull())


def cascade(direct: DataFrame, provides: DataFrame, uses: DataFrame, rows: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All orphans with ``inherited`` (false for the direct ones) and ``round`` (0 for the direct ones).

    ``provides`` and ``uses`` are the foreign-key graph as (table_name, row_id, link): a record provides the link keys
    under which others find it and uses those of the records it needs. ``rows`` has (table_name, row_id, at) of all
    records, for the times of inherited orphans. A link that nobody provides has no record that could be orphaned: those
    references are what ``unprovided`` finds.
    Rounds go on until one finds nothing new; more than ``max_rounds`` with finds, if given, are an error.
    """
    links = materialize(provides.where(F.col("link").isNotNull()).distinct(), "orphan-provides")
    needs = materialize(uses.where(F.col("link").isNotNull()).distinct(), "orphan-uses")
    busy = salts_for(needs.groupBy("link").agg(F.count("*").alias("n")), ["link"])
    found = materialize(direct.select("table_name", "row_id", "at", "reason", F.lit(False).alias("inherited"), F.lit(0).alias("round")), "orphan-direct")
    for turn in count(1):
        marked = links.join(found.select("table_name", "row_id", F.lit(1).alias("lost")), ["table_name", "row_id"], "left")
        gone = marked.groupBy("link").agg(F.min(F.coalesce("lost", F.lit(0))).alias("lost")).where("lost = 1").select("link")
        ids = salted_join(needs, gone, ["link"], "left_semi", busy).select("table_name", "row_id").distinct().join(found, ["table_name", "row_id"], "left_anti")
        new = materialize(rows.select("table_name", "row_id", "at").join(ids, ["table_name", "row_id"], "left_semi").select("table_name", "row_id", "at", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("inherited"), F.lit(turn).alias("round")), "orphan-round")
        if new.isEmpty():
            break
        if max_rounds is not None and turn > max_rounds:
            raise RuntimeError(f"orphans are still found after {max_rounds} rounds")
        found = found.unionByName(new)
    return found


def unprovided(provides: DataFrame, uses: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_name, row_id, at, link): references inside the graph to links that no record provides at all; null links are
    no references. The links that are missing are found among the distinct ones, then traced back to their users."""
    needs = materialize(uses.where(F.col("link").isNotNull()).distinct(), "orphan-uses")
    missing = needs.select("link").distinct().join(provides.where(F.col("link").isNotNull()).select("link").distinct(), "link", "left_anti")
    users = salted_join(needs, missing, ["link"], "left_semi")
    return users.join(rows.select("table_name", "row_id", "at"), ["table_name", "row_id"]).select("table_name", "row_id", "at", "link")


def orphans_by_period(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Counts per table and period, direct ones by reason."""
    return orphans.groupBy("table_name", F.date_trunc(period, "at").alias("period"), "inherited", "reason").agg(F.count("*").alias("n_rows"))

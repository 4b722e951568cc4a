"""Loading: gate, dedupe, naming, overlay, upsert, soft delete.

Keys are ``(facility_id, external_id)``.  Joins are on the whole key, which is
unique, so a facility with very many rows spreads over all tasks.  Rows with a
null key part never match anything; they are set aside before a join, because
all of them would hash to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dictionaries as D
from ..functions.text import col
from ..session import freeze
from .ordered import fixed_chunks, newest_per_key, row_numbers, running_sum

KEY = ("facility_id", "external_id")
# fixed values: columns an update leaves as they were
KEPT_ON_UPDATE = ("animal_type", "transfer_decided", "created_at")
# fixed values: what a missing value is loaded as
DEFAULTS = {"animal_type": "unknown", "gender": "unknown", "status": "available", "listing_type": "adoption"}


def _has_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


# ---- row preparation -----------------------------------------------------------

def default_name(name: str | Column, kind: str | Column, key: str | Column) -> Column:
    """Empty and placeholder names become the type's prefix and the key."""
    n, k = col(name), col(kind)
    prefix = F.lit(D.PLACEHOLDER_NAME)
    for value, text in D.NAME_PREFIX.items():
        prefix = F.when(k == value, text).otherwise(prefix)
    missing = n.isNull() | (n == "") | n.contains(D.PLACEHOLDER_NAME)
    return F.when(missing, F.concat(prefix, col(key))).otherwise(n)


def with_defaults(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Null and empty values replaced, for the columns the frame has."""
    chosen = DEFAULTS if defaults is None else defaults
    return df.withColumns(
        {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in chosen.items() if c in df.columns}
    )


def gate(rows: DataFrame, override: bool = False) -> DataFrame:
    """``outcome`` of each row: loaded, or why it is skipped.

    Reads ``document_level, external_id, needs_review, extraction_error``.  A
    critical document is rejected whole.  ``override`` lets critical documents,
    rows marked for review and rows without a key through; extraction errors
    never load.
    """
    strict = F.lit(not override)
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(strict & (F.col("document_level") == "critical"), "rejected_document")
        .when(truth("extraction_error"), "skipped_error")
        .when(strict & (F.col("external_id").isNull() | (F.col("external_id") == "")), "skipped_no_key")
        .when(strict & truth("needs_review"), "skipped_review")
        .otherwise("loaded")
    )
    return rows.withColumn("outcome", outcome)


def load_totals(rows: DataFrame, by: Sequence[str] = ("facility_id",)) -> DataFrame:
    """Rows by outcome (inserted, updated, skipped, errors) per group."""
    skipped = F.col("outcome").startswith("skipped") | F.col("outcome").startswith("rejected")
    n = lambda cond, a: F.count_if(cond).alias(a)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), n(F.col("outcome") == "inserted", "inserted"),
        n(F.col("outcome") == "updated", "updated"), n(skipped, "skipped"), n(F.col("outcome") == "error", "errors"),
    )


def last_wins(batch: DataFrame, position: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """One row per key, the last by ``position``; rows without a key all stay."""
    keyed = newest_per_key(batch.filter(_has_key(keys)), list(keys), list(position))
    return keyed.unionByName(batch.filter(~_has_key(keys)))


# ---- table changes ---------------------------------------------------------------

def classify_upsert(source: DataFrame, target: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Source rows with ``is_new``."""
    present = target.filter(_has_key(keys)).select(*keys).distinct().withColumn("_known", F.lit(True))
    keyed = source.filter(_has_key(keys)).join(present, list(keys), "left")
    keyed = keyed.withColumn("is_new", F.col("_known").isNull()).drop("_known")
    return keyed.unionByName(source.filter(~_has_key(keys)).withColumn("is_new", F.lit(True)))


def upsert(
    target: DataFrame, source: DataFrame, now: Column, keys: Sequence[str] = KEY, kept: Sequence[str] = KEPT_ON_UPDATE,
    position: Sequence[str] = (),
) -> DataFrame:
    """The target after the source is merged in.

    The target holds one row per key.  So does the source, or ``position``
    names the columns that order it and the last row of a key wins; the join
    then reuses the exchange of that step.  A matched row takes
    the source's values (null included) except ``kept``; a new row gets
    ``created_at`` and both get ``updated_at``.  Columns only the target has
    stay as they are.
    """
    keys = list(keys)
    values = [c for c in target.columns if c not in keys]
    stamps = ("created_at", "updated_at")
    t = target.filter(_has_key(keys)).select(*keys, F.struct(*values).alias("_t"))
    s_values = [c for c in source.columns if c not in keys and c not in position]
    keyed = source.filter(_has_key(keys))
    values_of = F.struct(*s_values)
    if position:
        s = keyed.groupBy(*keys).agg(F.max_by(values_of, F.struct(*position)).alias("_s"))
    else:
        s = keyed.select(*keys, values_of.alias("_s"))
    both = t.join(s, keys, "full_outer")
    old, new = F.col("_t").isNotNull(), F.col("_s").isNotNull()

    def value(c: str) -> Column:
        kind = target.schema[c].dataType
        if c == "updated_at":
            return F.when(new, now).otherwise(F.col("_t")[c]).cast(kind)
        if c == "created_at":
            return F.when(old, F.col("_t")[c]).otherwise(now).cast(kind)
        if c not in s_values:
            return F.col("_t")[c]
        if c in kept:
            return F.when(old, F.col("_t")[c]).otherwise(F.col("_s")[c]).cast(kind)
        return F.when(new, F.col("_s")[c]).otherwise(F.col("_t")[c]).cast(kind)

    merged = both.select(*keys, *[value(c).alias(c) for c in values])
    loose = source.filter(~_has_key(keys)).select(
        *keys,
        *[
            (now if c in stamps else F.col(c) if c in s_values else F.lit(None)).cast(target.schema[c].dataType).alias(c)
            for c in values
        ],
    )
    unkeyed = target.filter(~_has_key(keys)).select(*keys, *values)
    return merged.unionByName(unkeyed).unionByName(loose).select(*target.columns)


def touched(target: DataFrame, source: DataFrame, partition: str = "facility_id") -> DataFrame:
    """Target rows of the facilities in the source: all an incremental load has
    to read and rewrite when the table is partitioned by facility."""
    return target.join(source.select(partition).distinct(), partition, "left_semi")


#: Rows of a table that a task of a join sorts.
ROWS_PER_TASK = 250_000


def mark_removed(
    target: DataFrame, current: DataFrame, scraped: DataFrame, now: Column, keys: Sequence[str] = KEY
) -> DataFrame:
    """Available rows of ``scraped`` facilities that are not in ``current``
    become removed.  A scraped facility with no current rows loses all."""
    facility, keys = keys[0], list(keys)
    in_scope = scraped.select(facility).distinct().withColumn("_scope", F.lit(True))
    seen = current.filter(_has_key(keys)).select(*keys).distinct().withColumn("_seen", F.lit(True))
    open_ = F.col("status") == "available"
    candidates = target.filter(open_ & _has_key(keys))
    gone = F.col("_scope").isNotNull() & F.col("_seen").isNull()
    # both joins are dealt by counted rows, as coalescing would fill a task for each core, whatever the rows; there are at
    # most as many facilities over a task's rows as there are tasks, and these are cut into parts
    per_facility = freeze(candidates.groupBy(facility).agg(F.count(F.lit(1)).alias("_n")))
    tasks = max(1, -(-(per_facility.agg(F.sum("_n")).first()[0] or 0) // ROWS_PER_TASK))
    hot = F.broadcast(per_facility.filter(F.col("_n") > ROWS_PER_TASK).select(facility, F.ceil(F.col("_n") / ROWS_PER_TASK).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    marked = candidates.repartition(tasks, *keys).join(seen, keys, "left").join(hot, facility, "left")
    marked = marked.withColumn("_part", F.pmod(F.xxhash64(*keys), parts).cast("int")).drop("_parts")
    scope = in_scope.join(hot, facility, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    changed = (
        marked.repartition(tasks, facility, "_part").join(scope, [facility, "_part"], "left")
        .withColumn("updated_at", F.when(gone, now).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(gone, "removed").otherwise(F.col("status")))
        .select(*target.columns)
    )
    return changed.unionByName(target.filter(~F.coalesce(open_, F.lit(False)) | ~_has_key(keys)))


def overlay(
    rows: DataFrame, found: DataFrame, key: str, always: Sequence[str], when_present: Sequence[str] = (), flags: dict[str, object] | None = None
) -> DataFrame:
    """Fields of ``found`` laid over the rows with the same key.

    ``always`` fields are taken with their nulls, ``when_present`` only when
    not null, ``flags`` are set on matched rows.  Unmatched rows stay.
    """
    side = found.select(key, F.struct(*always, *when_present).alias("_f"))
    hit = F.col("_f").isNotNull()
    out = rows.join(side, key, "left")
    changes = {c: F.when(hit, F.col("_f")[c]).otherwise(F.col(c)) for c in always}
    changes |= {c: F.coalesce(F.col("_f")[c], F.col(c)) for c in when_present}
    changes |= {c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in (flags or {}).items()}
    return out.withColumns(changes).drop("_f")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``added``, ``removed``, ``changed`` or ``same`` for each key of two snapshots."""
    b = before.select(*keys, F.struct(*values).alias("_b"))
    a = after.select(*keys, F.struct(*values).alias("_a"))
    change = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    )
    return b.join(a, list(keys), "full_outer").select(*keys, change.alias("change"))


# ---- dedupe ------------------------------------------------------------------------

def first_seen(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    from .ordered import oldest_per_key

    return oldest_per_key(df, list(keys), list(position))


def preferred(df: DataFrame, keys: Sequence[str], prefer: Column, position: Sequence[str]) -> DataFrame:
    """One row per key: the first with ``prefer``, else the first."""
    from .ordered import oldest_per_key

    ranked = df.withColumn("_rank", F.when(prefer, 0).otherwise(1))
    return oldest_per_key(ranked, list(keys), ["_rank", *position]).drop("_rank")


# ---- unique names --------------------------------------------------------------------

SUFFIX = r"^(.*)-([1-9][0-9]{0,17})$"


def unique_names(
    df: DataFrame, group: str = "facility_id", name: str = "name", position: str = "position", out: str = "unique_name",
    chunk: int = 100_000,
) -> DataFrame:
    """Names made unique within a group as if rows came one by one in ``position``:
    a taken name gets ``-2``, ``-3`` and so on, whichever is free.

    ``position`` is a dense integer within the group.  No group is gathered.
    The *j*-th row with one name takes the *j*-th slot of that name (slot 1 the
    name itself, slot *k* the name with ``-k``), leaving out slots which a row
    *named* like the slot took first.  Such contests are a small table (name,
    slot); it is settled by iterating until nothing changes, which it reaches
    because each contest only depends on earlier ones.
    """
    keys = [group, name]
    ranked = row_numbers(fixed_chunks(df, position, chunk), keys, [F.col(position)], "_j")
    per_name = df.groupBy(*keys).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
    child = per_name.select(
        group, F.col(name).alias("_child"), "_first",
        F.regexp_extract(name, SUFFIX, 1).alias(name), F.regexp_extract(name, SUFFIX, 2).try_cast("bigint").alias("_k"),
    ).filter(F.col("_k") >= 2)
    siblings = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    contests = freeze(
        child.join(per_name.select(*keys, "_n"), keys)
        .join(siblings, keys)
        # a slot beyond all rows and skips of the parent is never reached
        .filter(F.col("_k") <= F.col("_n") + F.col("_m") + 1)
        .select(group, name, "_child", "_k", "_first", "_n", F.lit(True).alias("_own"))
    )
    if contests.isEmpty():
        label = F.when(F.col("_j") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_j")))
        return ranked.withColumn(out, label).drop("_j")

    taken_at = ranked.select(group, name, F.col("_j").alias("_at"), F.col(position).alias("_when"))
    while True:
        before = running_sum(
            fixed_chunks(contests, "_k", chunk), keys, ["_k"], F.col("_own").cast("long"), "_owned"
        ).withColumn("_owned", F.col("_owned") - F.col("_own").cast("long"))
        parent = contests.select(group, F.col("_child").alias(name), F.col("_own").alias("_parent_own"))
        at = (
            before.join(parent, keys, "left")
            .withColumn("_at", F.col("_k") - 1 - F.col("_owned") + F.when(F.coalesce("_parent_own", F.lit(True)), 1).otherwise(0))
            .drop("_parent_own", "_owned")
        )
        settled = freeze(
            at.join(taken_at, [*keys, "_at"], "left")
            .withColumn("_new", F.col("_when").isNull() | (F.col("_first") < F.col("_when")))
            .select(group, name, "_child", "_k", "_first", "_n", "_own", "_new")
        )
        changed = not settled.filter(F.col("_own") != F.col("_new")).isEmpty()
        contests = settled.drop("_own").withColumnRenamed("_new", "_own")
        if not changed:
            break

    lost = contests.filter(~F.col("_own")).select(group, F.col("_child").alias(name), F.lit(1).alias("_lost"))
    owned = running_sum(
        fixed_chunks(contests.filter("_own").withColumn("_one", F.lit(1)), "_k", chunk), keys, ["_k"], F.col("_one"), "_i"
    ).join(lost, keys, "left")
    # the slot k is skipped by every row after the first k - i (- 1) ones
    skips = owned.select(
        group, name, (F.col("_k") - F.col("_i") - F.coalesce("_lost", F.lit(0))).alias("_j"), F.lit(1).alias("_skip")
    )
    rows = ranked.join(lost, keys, "left")
    mixed = rows.withColumn("_skip", F.lit(0)).unionByName(skips, allowMissingColumns=True)
    # a skip at j counts for rows with a larger j: order rows before skips at equal j
    total = running_sum(fixed_chunks(mixed, "_j", chunk), keys, ["_j", "_skip"], F.col("_skip"), "_skipped")
    slot = F.col("_j") + F.col("_skipped") + F.coalesce("_lost", F.lit(0))
    label = F.when(slot == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), slot))
    return total.filter(F.col("_skip") == 0).withColumn(out, label).select(*df.columns, out)

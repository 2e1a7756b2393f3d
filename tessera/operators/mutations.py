"""Mutations and state machines as functions from old tables to new ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sync states.
LOCAL_ONLY, SYNCING, SYNCED, SERVER_ONLY, MISSING = range(5)


def last_per_key(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    rank = Window.partitionBy(*keys).orderBy(F.col(order).desc() if isinstance(order, str) else order.desc())
    return df.withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; ``new`` has one row a key (see last_per_key)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added; of equal new keys one is."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def update_by_key(old: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns set from ``updates`` (one row a key); unknown keys change nothing, and a null in an update is set too."""
    new = updates.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = old.join(new, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def fill_or_overwrite(old: DataFrame, new: DataFrame, keys: list[str], fill: dict[str, Column], overwrite: list[str]) -> DataFrame:
    """``fill`` columns take the new value where the old is the given default; ``overwrite`` columns always take it."""
    got = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in [*fill, *overwrite]], F.lit(True).alias("__hit"))
    joined = old.join(got, keys, "left")

    def value(c: str) -> Column:
        if c in fill:
            return F.when(F.col("__hit") & (F.col(c) == fill[c]), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
        if c in overwrite:
            return F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*map(value, old.columns))


def validated_state(state: Column, present: Column) -> Column:
    """Server-only rows stay; a missing file makes Synced server-only and all else Missing; a present one ends Missing."""
    return (
        F.when(state == SERVER_ONLY, state)
        .when(~present, F.when(state == SYNCED, SERVER_ONLY).otherwise(MISSING))
        .when(state == MISSING, LOCAL_ONLY)
        .otherwise(state)
    )


def synced(local: DataFrame, server: DataFrame, key: str, state: str) -> DataFrame:
    """(key, state) after a comparison with the server's ids: a full outer join and one case."""
    here = local.select(F.col(key).alias("__l"), F.col(state).alias("__s"))
    there = server.select(F.col(key).alias("__r")).distinct()
    both = here.join(there, F.col("__l") == F.col("__r"), "full")
    known = F.col("__r").isNotNull()
    after = (
        F.when(F.col("__l").isNull(), SERVER_ONLY)
        .when(known & (F.col("__s") == LOCAL_ONLY), SYNCED)
        .when(known & (F.col("__s") == MISSING), SERVER_ONLY)
        .when(~known & (F.col("__s") == SYNCED), LOCAL_ONLY)
        .otherwise(F.col("__s"))
    )
    return both.select(F.coalesce("__l", "__r").alias(key), after.cast("int").alias(state))


def resolve_stacks(files: DataFrame, key: str, group: list[str], category: str, size: str) -> DataFrame:
    """(key, stack_id, stack_primary): groups of two or more files of unlike category; the first by category, then size, then key leads."""
    per = Window.partitionBy(*group)
    lead = per.orderBy(F.desc(category), F.desc(size), key)
    marked = files.withColumn("__n", F.count("*").over(per)).withColumn("__lo", F.min(category).over(per)).withColumn("__hi", F.max(category).over(per)).withColumn("__r", F.row_number().over(lead)).withColumn("__id", F.first(key).over(lead))
    return marked.where("__n >= 2 and __lo <> __hi").select(key, F.col("__id").alias("stack_id"), (F.col("__r") == 1).alias("stack_primary"))


def merge_keys(rows: DataFrame, column: str, target, source) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) == source, F.lit(target)).otherwise(F.col(column)))


def suffixed(df: DataFrame, folder: str, name: str, key: str, first: int = 1, joiner: str = "-") -> DataFrame:
    """``target``: the name, and for later rows of the same folder and name the name with -1, -2, ... before its extension."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(key)) - 1
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return df.withColumn("target", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit(joiner), (n + first - 1).cast("string"), ext)))


def free_names(df: DataFrame, taken: DataFrame, folder: str, name: str, key: str, first: int = 1, joiner: str = "-") -> DataFrame:
    """``target``: a name that is free in the folder, by two passes over the rows in the order of ``key``.

    A row whose name is not in ``taken`` (folder, name) and that is the first to ask for it keeps it. The others of a folder, stem and extension get
    stem, ``joiner``, number: the smallest numbers from ``first`` on that are neither taken nor asked for as they are by another row. So names asked for
    come before numbered ones, and no two rows, nor a row and a taken name, are equal. The n-th free number comes from the gaps between those in use,
    which are joined by rank ranges; no folder is gathered in one list. Null folders are one folder; a null name stays null. Keys should be unique.
    """
    parts = lambda c: (F.regexp_extract(c, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(c, r"(?s)^(.+?)(\.[^.]*)?$", 2))
    place = F.coalesce(F.col(folder).cast("string"), F.lit("")).alias("__folder"), F.col(folder).isNull().alias("__nowhere")
    where = ["__folder", "__nowhere"]
    held = taken.where(F.col(name).isNotNull()).select(*place, F.col(name).alias("__name")).distinct()
    asked = df.select("*", *place, F.col(name).alias("__name"))
    turn = F.row_number().over(Window.partitionBy(*where, "__name").orderBy(key))
    asked = asked.withColumn("__turn", turn).join(held.withColumn("__held", F.lit(True)), [*where, "__name"], "left")
    keeps = (F.col("__turn") == 1) & F.col("__held").isNull() | F.col("__name").isNull()
    asked = asked.withColumn("__keeps", keeps)
    stem, ext = parts("__name")
    asked = asked.withColumns({"__stem": stem, "__ext": ext})
    group = [*where, "__stem", "__ext"]

    # numbers in use: of names that end in the joiner and a number, whether taken or asked for
    used = held.unionByName(asked.where("__keeps and __name is not null").select(*where, "__name")).distinct()
    body, tail = parts("__name")
    number = F.regexp_extract(body, rf"(?s)^.+{re.escape(joiner)}([1-9][0-9]{{0,8}}|0)$", 1)
    used = used.select(*where, body.alias("__body"), tail.alias("__ext"), number.alias("__digits")).where("__digits <> ''")
    used = used.select(*where, F.expr(f"substring(__body, 1, length(__body) - length(__digits) - {len(joiner)})").alias("__stem"), "__ext", F.col("__digits").cast("long").alias("__used")).where(F.col("__used") >= first)
    used = used.join(asked.where("not __keeps").select(*group).distinct(), group, "left_semi")
    before = F.row_number().over(Window.partitionBy(*group).orderBy("__used")) - 1
    gaps = used.withColumn("__from", F.col("__used") - first - before)  # free numbers below this used one
    # the n-th free number (from 0) is n + first, plus the used ones of which at most n free numbers are below
    wants = asked.where("not __keeps").withColumn("__n", (F.row_number().over(Window.partitionBy(*group).orderBy(key, "__name")) - 1).cast("long"))
    steps = gaps.select(*group, F.col("__from").alias("__n"), F.lit(0).alias("__what")).unionByName(wants.select(*group, "__n", F.lit(1).alias("__what")))
    passed = F.sum(1 - F.col("__what")).over(Window.partitionBy(*group).orderBy("__n", "__what").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = steps.withColumn("__skip", passed).where("__what = 1").select(*group, "__n", "__skip")
    numbered = wants.join(found, [*group, "__n"]).withColumn("target", F.concat("__stem", F.lit(joiner), (F.col("__n") + first + F.col("__skip")).cast("string"), "__ext"))
    kept = asked.where("__keeps").withColumn("target", F.col("__name"))
    return kept.select(*df.columns, "target").unionByName(numbered.select(*df.columns, "target"))


def migrate(df: DataFrame, steps: list[tuple[str, str, str, object]]) -> DataFrame:
    """Schema steps in order: (add, column, type, default), (rename, old, new, None), (drop, column, '', None); an added column that exists stays."""
    for what, column, detail, value in steps:
        if what == "add":
            df = df if column in df.columns else df.withColumn(column, F.lit(value).cast(detail))
        elif what == "rename":
            df = df.withColumnRenamed(column, detail)
        elif what == "drop":
            df = df.drop(column)
        else:
            raise ValueError(f"unknown step {what}")
    return df


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of rows whose other columns are not all the same in both tables (null equals null)."""
    rest = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*rest).alias("__a")).join(new.select(key, F.struct(*rest).alias("__b")), key)
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key)


def merge_persons(rows: DataFrame, persons: DataFrame, owner: str, key: str, target, source) -> tuple[DataFrame, DataFrame]:
    """(rows, persons): rows of ``source`` go to ``target``, and the source person is deleted."""
    return merge_keys(rows, owner, target, source), persons.where(~F.col(key).eqNullSafe(F.lit(source)))


def rename_unique(rows: DataFrame, key: str, name: str, which, new: str) -> DataFrame:
    """``rows`` with one renamed, and ``renamed``: whether that was done. A name that another row has changes nothing."""
    taken = rows.where((F.col(name) == new) & (F.col(key) != which)).limit(1).agg((F.count("*") > 0).alias("__taken"))
    free = rows.crossJoin(F.broadcast(taken)).withColumn("renamed", (F.col(key) == which) & ~F.col("__taken"))
    return free.withColumn(name, F.when(F.col("renamed"), F.lit(new)).otherwise(F.col(name))).drop("__taken")


def insert_valid(old: DataFrame, new: DataFrame, keys: list[str], valid: Column) -> tuple[DataFrame, DataFrame]:
    """(table, (offered, inserted)): the valid new rows are added, others counted only; of rows whose key is there or repeats one at most is."""
    fit = new.where(valid).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    counts = new.agg(F.count("*").alias("offered")).crossJoin(fit.agg(F.count("*").alias("inserted")))
    return old.unionByName(fit), counts

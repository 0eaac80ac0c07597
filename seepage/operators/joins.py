"""Equi-joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``many`` to ``few`` on ``on`` with every key spread over ``salts`` tasks.

    Rows of ``many`` get a salt from their own content, rows of ``few`` are
    repeated once per salt, so a key that holds a third of ``many`` is shared
    by that many tasks.  ``few`` has to be the smaller, narrow side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    # maps cannot be hashed; the salt has to come out the same when a task is run again
    hashed = [name for name, kind in many.dtypes if "map<" not in kind]
    keyed = many.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.join(repeated, [on, "_salt"], how).drop("_salt")


#: Rows of one key that one task may take, most keys that are split, and keys that the sketch keeps track of.
TASK_ROWS, MOST_HOT, TRACKED = 200_000, 1_000, 10_000


def hot_keys(rows: DataFrame, on: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """(key, ``_salts``) of the keys with more than ``task_rows`` rows, at most ``MOST_HOT`` of them.

    A heavy-hitter sketch counts the keys in one pass; each task hands on one
    sketch.  Its counts are never too low by more than a ``TRACKED``-th of all rows.
    """
    top = rows.filter(F.col(on).isNotNull()).agg(F.expr(f"approx_top_k(`{on}`, {MOST_HOT}, {TRACKED})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(
        F.col("t.item").alias(on), F.ceil(F.col("t.count") / task_rows).cast("int").alias("_salts")).filter("_salts > 1")


def measured_join(many: DataFrame, few: DataFrame, on: str, task_rows: int = TASK_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` with ``few`` in which only keys that are hot in ``many`` are split.

    Their rows are dealt out over as many tasks as their number asks for, and
    the rows of ``few`` with these keys are repeated for them; no other row is
    repeated.  The keys are counted in ``counted``, or in ``many``, which is
    then read twice and should be stored or narrow.
    """
    hot = F.broadcast(hot_keys(many if counted is None else counted, on, task_rows))
    hashed = [name for name, kind in many.dtypes if "map<" not in kind]
    # the salt has to come out the same when a task is run again
    dealt = many.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    repeated = few.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(repeated, [on, "_salt"]).drop("_salt")

"""Exact duplicates by a tree of merges of sorted digest runs, in DataFrame operations only.

Each part of the input is a run: its rows' digests, sorted and merged with their least row and their number. In each round the runs
are taken in groups of ``fan_in`` neighbours (run number divided by ``fan_in``), and the group's entries of one digest, at most
``fan_in`` of them, are merged to one. Rounds go on until one run is left; its entries are dealt to all tasks by digest in every round.
A digest that half of all rows share is therefore never more than ``fan_in`` rows for the task that merges it.

Entries are sorted and dealt by a 64-bit digest and verified by SHA-256 and the length in every merge, so that texts whose short
digests agree by chance are kept apart. The order of rows in a group is: smallest id, null ids last, then the place in the input; so
exactly one row of each group stays, whatever ids are null or repeated.

Back at the rows: groups of one need no partner. Of the others those with more than 1 / ``HEAVY`` of all rows, fewer than ``HEAVY`` groups by
count, are broadcast; the rest is joined by digest.

Null text counts as empty. An empty table gives an empty result. Texts may be as long as a row can be. Other columns aren't read, unless
named in ``carry``; those come back in one struct, so that no name clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import materialise

#: groups with more than 1 / HEAVY of all rows are broadcast: there are fewer than HEAVY of them
HEAVY = 4096
KEY = ("short", "sha", "length")


def normalised(text: Column) -> Column:
    """Each run of ASCII blanks becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_column: str, text_column: str, carry: Sequence[str]) -> DataFrame:
    """id, digests and length of each row, its place and its run: written, since places must not change between the readings."""
    more = [F.struct(*carry).alias("carried")] if carry else []
    out = docs.select(
        F.col(id_column).alias("id"),
        normalised(F.col(text_column)).alias("t"),
        F.monotonically_increasing_id().alias("place"),
        F.spark_partition_id().alias("run"),
        *more,
    )
    return materialise(
        out.select(
            "id",
            F.xxhash64("t").alias("short"),
            F.unhex(F.sha2("t", 256)).alias("sha"),
            F.octet_length("t").alias("length"),
            "place",
            "run",
            *["carried" for _ in more],
        ),
        "digests",
    )


def merge_tree(rows: DataFrame, fan_in: int = 16) -> DataFrame:
    """Key, ``first`` (the least row) and ``n`` of each group."""
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("place").alias("place"))
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    runs, least, number = rows, F.min(row), F.count(F.lit(1))
    while True:  # the first round's partial aggregation sorts and merges each run where it is read
        left = -(-left // fan_in)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        runs = runs.groupBy("run", *KEY).agg(least.alias("first"), number.alias("n"))
        if left == 1:
            break
        least, number = F.min("first"), F.sum("n")
    return runs.drop("run")


def find(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: Sequence[str] = (),
    fan_in: int = 16,
) -> DataFrame:
    """One row for each of ``docs``: id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256`` (of the text as
    compared), and ``carried``, if columns are to be carried."""
    rows = digests(docs, id_column, text_column, carry)
    many = materialise(merge_tree(rows.select("id", *KEY, "place", "run"), fan_in).where("n > 1"), "copies")
    is_heavy = F.col("n") * HEAVY > rows.count()
    heavy, rest = F.broadcast(many.where(is_heavy)), many.where(~is_heavy)
    found = rows.join(heavy, list(KEY)).unionByName(rows.join(heavy, list(KEY), "left_anti").join(rest, list(KEY), "left"))
    alone = F.col("n").isNull()
    return found.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("first.place"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(["carried"] if carry else []),
    )

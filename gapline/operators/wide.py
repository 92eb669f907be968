"""Very long records in many tasks: the same boundaries and segments as those of the other operators, which give a chunk to one task.

A chunk's text is cut at blanks into pieces, which are tokenised anywhere; the counts of the pieces give each token its place. Windows of gap scores and
valleys run in blocks of ``block`` tokens, with as many tokens of the neighbouring blocks as a window reaches (:func:`in_blocks`).

* The greedy choice (lowest gap first, none nearer than ``apart`` to a chosen one) is local: a candidate is chosen if all lower ones near
  it are out, and out if one of them is chosen. Each block decides what its own candidates and those within ``VIEW`` times ``apart`` of it
  allow; the rest waits for the neighbours' decisions of the round before. The lowest undecided candidate is decided in every round, so the rounds end;
  nearly all candidates are decided in the first.
* Spans that are too long are split each on its own. A span of more than ``block`` tokens is split by an aggregation over its gaps, all such spans of
  a round together, until every part fits a task. The splitter of a whole chunk stops at the first span without a place; so the leftmost such
  span of each chunk is found, and cuts of spans that begin behind it are left out.
* Running numbers (of segments) are counted in the blocks and moved by the totals of the blocks before.

Between rounds the few columns that decide are written to the folder that all executors share.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline import config as C
from gapline.config import Config
from gapline.functions import text as T
from gapline.operators import decode
from gapline.operators.gaps import CHUNK, RECORD
from gapline.sources.shared import Scope

#: characters of a piece
PIECE = 1 << 16
#: tokens of a block
BLOCK = 50_000
#: how far a block looks for candidates outside, in least distances
VIEW = 20
UNDECIDED, CHOSEN, OUT = 0, 1, 2
KEYS = "Record_ID string, Source_Row long, Source_Column string, chunk int"


def tokens(transcripts: DataFrame, scope: Scope, clean_text: bool = True, piece: int = PIECE) -> DataFrame:
    """As :func:`gapline.operators.gaps.tokens`, from transcripts."""
    body = transcripts.select(*RECORD, T.normalize(F.col("text"), clean_text).alias("text")).where("text <> ''")
    parts = body.select(*RECORD, T.truncated(F.col("text")).alias("truncated"), F.posexplode(F.split("text", C.EVENT)).alias("chunk", "part"))
    cut = F.regexp_extract_all("part", F.lit(rf"(?s)(.{{1,{piece}}}\S*)"), F.lit(1))
    cut = F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("")))
    pieces = parts.select(*RECORD, "chunk", "truncated", F.posexplode(cut).alias("piece", "part")).repartition(*CHUNK, "piece")
    pieces = scope.keep(pieces.select(*CHUNK, "piece", "truncated", T.tokenize(F.col("part")).alias("tokens")))
    sizes = pieces.select(*CHUNK, "piece", F.size("tokens").alias("n"))  # a number for each piece: few for a record
    before = Window.partitionBy(*CHUNK).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns(
        {"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "n_tokens": F.sum("n").over(Window.partitionBy(*CHUNK)).cast("int")}
    )
    totals = sizes.groupBy(*CHUNK).agg(F.first("n_tokens").alias("n_tokens"))
    ahead = Window.partitionBy(*RECORD).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum(F.col("n_tokens") + 1).over(ahead), F.lit(0)).cast("int")).drop("n_tokens")
    placed = pieces.join(sizes, [*CHUNK, "piece"]).join(totals, list(CHUNK)).where("n_tokens > 1")
    out = placed.select(*CHUNK, "offset", "n_tokens", "truncated", "base", F.posexplode("tokens").alias("at", "token"))
    return out.select(*CHUNK, "offset", "n_tokens", "truncated", (F.col("base") + F.col("at")).cast("int").alias("pos"), "token")


def in_blocks(rows: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Adds block and own: each row for its own block, and for a neighbour if it is within ``reach`` of it."""
    if reach > block:
        raise ValueError("a block is at least as long as what it reads of its neighbours")
    own = F.floor(F.col("pos") / block).cast("int")
    at = F.col("pos") % block
    before = F.when((at < reach) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own")))
    after = F.when(at >= block - reach, F.struct((own + 1).alias("block"), F.lit(False).alias("own")))
    each = F.array_compact(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), before, after))
    return rows.select("*", F.explode(each).alias("b_")).select(*rows.columns, "b_.block", "b_.own")


def _decide(rows: pd.DataFrame, apart: int, lo: int, hi: int) -> pd.DataFrame:
    """States of candidates (pos, k, state) of which all those with lo <= pos < hi are seen."""
    rows = rows.sort_values("pos", ignore_index=True)
    pos, k, state = (rows[c].to_numpy() for c in ("pos", "k", "state"))
    state = state.copy()
    where = pos.tolist()
    for i in np.lexsort((pos, k)).tolist():
        if state[i] != UNDECIDED:
            continue
        a, z = bisect.bisect_left(where, where[i] - apart + 1), bisect.bisect_left(where, where[i] + apart)
        near = state[a:z]
        if (near == CHOSEN).any():
            state[i] = OUT
            continue
        lower = (k[a:z] < k[i]) | ((k[a:z] == k[i]) & (pos[a:z] < pos[i]))
        if where[i] - apart + 1 >= lo and where[i] + apart <= hi and not (lower & (near == UNDECIDED)).any():
            state[i] = CHOSEN
    return rows.assign(state=state)


def greedy(candidates: DataFrame, config: Config, scope: Scope, block: int = BLOCK) -> DataFrame:
    """The chosen ones of ``candidates`` (keys, n_tokens, pos, k): as :func:`gapline.operators.decode.greedy` chooses them."""
    least, apart = config.min_segment_tokens, max(config.min_segment_tokens, config.nms_radius + 1)
    view = min(VIEW * apart, block)
    names = [*CHUNK, "n_tokens", "pos", "k", "state"]
    far = candidates.where((F.col("pos") >= least) & (F.col("n_tokens") - F.col("pos") >= least))
    kinds = f"{KEYS}, n_tokens int, pos int, k long, state int"
    state = far.withColumn("state", F.lit(UNDECIDED)).select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in kinds.split(", "))])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        b, n = int(pdf["block"].iloc[0]), int(pdf["n_tokens"].iloc[0])
        lo, hi = b * block - view, (b + 1) * block + view
        # nothing stands outside of the chunk, so nothing is hidden there
        out = _decide(pdf, apart, lo if lo > 0 else -apart, hi if hi < n else n + apart)
        return out.loc[out["own"], names]

    while True:
        state = scope.keep(in_blocks(state, view, block).groupBy(*CHUNK, "block").applyInPandas(decide, kinds))
        if state.where(F.col("state") == UNDECIDED).isEmpty():
            return state.where(F.col("state") == CHOSEN).select(*CHUNK, "n_tokens", "pos")


def _running(rows: DataFrame, value: Column, how: str, block: int) -> DataFrame:
    """Adds ``run_``: the sum or the last non-null of ``value`` (a whole number) up to and with each row, in order of pos; or the next one."""
    back = how == "next"
    order = F.desc("pos") if back else F.asc("pos")
    fold = {"sum": F.sum, "last": F.max, "next": F.min}[how]
    rows = rows.withColumns({"block_": F.floor(F.col("pos") / block).cast("int"), "value_": value})
    per = rows.groupBy(*CHUNK, "block_").agg(fold("value_").alias("total_"))
    ahead = Window.partitionBy(*CHUNK).orderBy(F.desc("block_") if back else F.asc("block_")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before_", fold("total_").over(ahead)).drop("total_")
    inside = Window.partitionBy(*CHUNK, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(per, [*CHUNK, "block_"]).withColumn("own_", fold("value_").over(inside))
    both = F.coalesce("own_", F.lit(0)) + F.coalesce("before_", F.lit(0)) if how == "sum" else F.coalesce("own_", "before_")
    return rows.withColumn("run_", both).drop("block_", "value_", "before_", "own_")


SPAN = f"{KEYS}, pos int, a int, z int, fails boolean"


def split_span(a: int, z: int, table: dict[str, np.ndarray], least: int, most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(place, beginning of the span that it cuts) of all cuts in the span, and the parts without a place. ``table`` is for the gaps a + 1 .. z - 1."""
    todo, cuts, stuck = [(a, z)], [], []
    while todo:
        x, y = todo.pop()
        if y - x <= most:
            continue
        at = np.arange(x + least, y - least + 1)
        allowed = next((p for p in (at[table["free"][at - a - 1]], at[table["usable"][at - a - 1]]) if len(p)), None)
        if allowed is None:
            stuck.append((x, y))
            continue
        order = np.lexsort((np.abs(2 * allowed - x - y), table["k"][allowed - a - 1], table["bonus"][allowed - a - 1]))
        best = int(allowed[order[0]])
        cuts.append((best, x))
        todo += [(x, best), (best, y)]
    return cuts, stuck


def forced(rows: DataFrame, chosen: DataFrame, config: Config, scope: Scope, block: int = BLOCK) -> DataFrame:
    """Keys and pos of the forced boundaries: ``rows`` (keys, n_tokens, pos, k, free, usable, bonus) are all gaps."""
    least, most = config.min_segment_tokens, config.max_segment_tokens
    mark = chosen.select(*CHUNK, "pos", F.lit(True).alias("cut_"))
    inside = rows.join(mark, [*CHUNK, "pos"], "left")
    here = F.when(F.col("cut_"), F.col("pos"))
    inside = _running(_running(inside, here, "last", block).withColumnRenamed("run_", "a"), here, "next", block).withColumnRenamed("run_", "z")
    inside = inside.where("cut_ is null").withColumns({"a": F.coalesce("a", F.lit(0)).cast("int"), "z": F.coalesce("z", "n_tokens").cast("int")})
    names = [*CHUNK, "pos", "k", "free", "usable", "bonus", "a", "z"]
    typed = {"Source_Row": F.col("Source_Row").cast("long"), "chunk": F.col("chunk").cast("int"), "pos": F.col("pos").cast("int")}
    left = scope.keep(inside.where(F.col("z") - F.col("a") > most).withColumns(typed).select(*names))
    found = []
    span = [*CHUNK, "a", "z"]
    while True:  # spans too long for a task: each is cut once in a round
        wide = left.where(F.col("z") - F.col("a") > block)
        if wide.isEmpty():
            break
        fits = (F.col("pos") >= F.col("a") + least) & (F.col("pos") <= F.col("z") - least) & (F.col("free") | F.col("usable"))
        place = F.struct(~F.col("free"), F.col("bonus"), F.col("k"), F.abs(2 * F.col("pos") - F.col("a") - F.col("z")), F.col("pos").alias("pos"))
        best = scope.keep(wide.groupBy(*span).agg(F.min(F.when(fits, place)).alias("b")).select(*span, F.col("b.pos").alias("best")))
        found.append(best.select(*CHUNK, F.col("best").alias("pos"), "a", "z", F.col("best").isNull().alias("fails")))
        parts = wide.join(best.where("best is not null"), span).where("pos <> best")
        parts = parts.withColumns({"z": F.when(F.col("pos") < F.col("best"), F.col("best")).otherwise(F.col("z")), "a": F.when(F.col("pos") > F.col("best"), F.col("best")).otherwise(F.col("a"))})
        rest = left.where(F.col("z") - F.col("a") <= block).select(*names)
        left = scope.keep(rest.unionByName(parts.where(F.col("z") - F.col("a") > most).select(*names)))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        key = {c: pdf[c].iloc[0] for c in CHUNK}
        a, z = int(pdf["a"].iloc[0]), int(pdf["z"].iloc[0])
        cuts, stuck = split_span(a, z, {c: pdf[c].to_numpy() for c in ("k", "free", "usable", "bonus")}, least, most)
        out = [{**key, "pos": p, "a": x, "z": z, "fails": False} for p, x in cuts] + [{**key, "pos": None, "a": x, "z": y, "fails": True} for x, y in stuck]
        return pd.DataFrame(out, columns=[*CHUNK, "pos", "a", "z", "fails"]).astype({"pos": "Int32"})

    found.append(left.groupBy(*span).applyInPandas(split, SPAN))
    cuts = scope.keep(functools.reduce(DataFrame.unionByName, found))
    first = cuts.where("fails").groupBy(*CHUNK).agg(F.min(F.struct("a", "z")).alias("f"))
    kept = cuts.where("not fails").join(first, list(CHUNK), "left").where(F.col("f").isNull() | (F.col("a") < F.col("f.z")))
    return kept.select(*CHUNK, "pos")


def select(found: DataFrame, config: Config, scope: Scope, block: int = BLOCK) -> DataFrame:
    """As :func:`gapline.operators.decode.select`, for the rows of :func:`gapline.operators.decode.valleys`."""
    free, usable, bonus = decode.split_columns()
    rows = scope.keep(
        found.select(
            *CHUNK, "n_tokens", "pos", "k", free.alias("free"), usable.alias("usable"), bonus.alias("bonus"), (F.col("candidate_boundary") & free).alias("candidate")
        )
    )
    chosen = scope.keep(greedy(rows.where("candidate").select(*CHUNK, "n_tokens", "pos", "k"), config, scope, block))
    more = forced(rows.drop("candidate"), chosen, config, scope, block)
    marks = chosen.select(*CHUNK, "pos", F.lit(False).alias("forced_")).unionByName(more.withColumn("forced_", F.lit(True)))
    out = found.join(scope.keep(marks), [*CHUNK, "pos"], "left")
    return out.withColumns(
        {"selected_boundary": F.col("forced_").isNotNull(), "forced_max_length_boundary": F.coalesce("forced_", F.lit(False))}
    ).drop("forced_")


def numbered(own: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds seg, the number of cuts up to each token, for :func:`gapline.operators.decode.segment_bodies`."""
    return _running(own, F.coalesce("selected_boundary", F.lit(False)).cast("int"), "sum", block).withColumnRenamed("run_", "seg")


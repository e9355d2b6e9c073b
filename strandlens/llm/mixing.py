"""Mixing sources to target weights as budgets of whole documents.

Documents are counted by exact length per source. Each source's target is a subset-sum problem over that
histogram: a first share of every length is taken in proportion, and what is left of the budget, now small, is
filled exactly or nearly by bounded-knapsack dynamic programming over lengths. Last, the documents of each
length are chosen by a seeded order until the length's count is reached."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
RANK_ROWS = 512  # about so many documents are ranked in one group
KNAPSACK = 1 << 16  # budget in words that the dynamic program covers


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; 0 for null."""
    plain = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(plain, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> adds rank, target. Sources by code point, null last, weigh ``weights`` in turn and
    share ``share`` of all sizes; a target stops at ``repeats`` times its source's size and the rest is shared
    again by weight. The level of that sharing is found by ordering sources by size over weight."""
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", weigh).withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    ranked = ranked.withColumn("_budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    # A source is capped if, with all smaller caps filled, an even level would still lift it over its cap.
    ranked = ranked.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    capped = F.col("_level") * F.col("_w") >= F.col("_cap")
    ranked = ranked.withColumn("_open", F.min(F.when(~capped, F.struct((F.col("_cap") / F.col("_w")).alias("a"), "rank", "_level"))).over(Window.partitionBy()))
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_open._level") * F.col("_w"))
    return ranked.select("source", "source_size", F.col("rank").cast("long").alias("rank"), target.alias("target"))


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as found.

    Proportional part first (rounded down), then lengths once more in a seeded order while they fit, until less
    than KNAPSACK words are left; the rest by dynamic programming over reachable sums."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    part = budget / total
    take = np.minimum(np.floor(counts * part).astype(np.int64), counts)
    left = budget - int((take * lengths).sum())
    while left < 0:  # the floor of a float may be one too high
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        left += int(lengths[i])
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(lengths))
    for i in order:
        if left <= KNAPSACK:
            break
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    # Bounded knapsack over a bit set: bit s is set when s words can be reached. Counts go in powers of two.
    top = min(left, KNAPSACK)
    mask, reach, steps = (1 << (top + 1)) - 1, 1, []
    for i in order:
        spare, k, length = int(counts[i] - take[i]), 1, int(lengths[i])
        while length and spare > 0 and k * length <= top and not reach >> top & 1:
            k = min(k, spare)
            grown = (reach | (reach << (k * length))) & mask
            if grown != reach:
                steps.append((i, k, reach))
                reach = grown
            spare -= k
            k *= 2
        if reach >> top & 1:
            break
    at = reach.bit_length() - 1
    for i, k, had in reversed(steps):
        if not had >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    short = left - (reach.bit_length() - 1)
    # One document too many is nearer than what is left out, where no sum fits well.
    spare = np.flatnonzero((take < counts) & (lengths < 2 * short) & (lengths > 0))
    if short > 0 and len(spare):
        take[spare[np.argmin(np.abs(lengths[spare] - short))]] += 1
    return take


def _plan(groups: pd.DataFrame) -> pd.DataFrame:
    groups = groups.sort_values("size", ignore_index=True)
    size, n = groups["size"].to_numpy(np.int64), groups["n"].to_numpy(np.int64)
    whole, target = int((size * n).sum()), float(groups["target"].iloc[0])
    rounds = int(min(target // whole, 1 << 30)) if whole else 0
    more = fill_budget(size, n, int(round(target - rounds * whole)), int(groups["rank"].iloc[0]))
    return pd.DataFrame({"rank": groups["rank"], "size": size, "base": np.int64(rounds), "more": more, "n": n})


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def _place(seed: str, *rest: str) -> Column:
    """A document's place in the seeded order of its length: by its id and text, then by ``rest``. Equal places are equal rows."""
    u = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return F.struct(u.alias("u"), F.xxhash64(F.lit(f"{seed}/2"), F.col("doc_id"), F.col("text"), *[F.col(f"`{c}`") for c in rest]).alias("v"))


def _cuts(slim: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """Per (source, size): source_size, target, base (times that every document is taken), and which are taken once more: all
    (whole), or those before the place ``cut`` and ``tied`` of the rows at it.

    ``slim``: source, size, at. Equal rows are counted before they are ranked, so rows that repeat are one row to the ranks."""
    counts = stage(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, repeats)
    goal = stage(goal, "mix-targets")
    lengths = counts.join(goal, counts["source"].eqNullSafe(goal["source"])).select(goal["rank"], "target", "size", "n")
    plan = lengths.groupBy("rank").applyInPandas(_plan, "rank long, size long, base long, more long, n long")
    plan = plan.join(goal, "rank")
    # The hash is even over its range: equal steps of it hold about equal numbers of a length's documents.
    plan = stage(plan.withColumn("parts", F.ceil(F.col("n") / RANK_ROWS).cast("long")), "mix-plan")
    partly = plan.filter("more > 0 and more < n").select(_key("source").alias("key"), "rank", "size", "more", "parts")
    part = F.floor((F.col("at.u").cast("double") / F.lit(2.0**64) + 0.5) * F.col("parts")).cast("long")
    rows = slim.select(_key("source").alias("key"), "size", "at").join(partly, ["key", "size"])
    rows = rows.groupBy("rank", "size", "more", F.least(part, F.col("parts") - 1).alias("part"), "at").agg(F.count("*").alias("times"))
    rows = stage(rows, "mix-places")
    sums = rows.groupBy("rank", "size", "part", "more").agg(F.sum("times").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("rank", "size").orderBy("part"))
    edge = sums.withColumn("upto", upto).filter("upto >= more and upto - here < more")
    edge = edge.select("rank", "size", "part", (F.col("more") - F.col("upto") + F.col("here")).alias("nth"))
    ranked = rows.drop("more").join(edge, ["rank", "size", "part"])
    upto = F.sum("times").over(Window.partitionBy("rank", "size", "part").orderBy("at"))
    cut = ranked.withColumn("_upto", upto).filter("_upto >= nth and _upto - times < nth")
    cut = cut.select("rank", "size", F.col("at").alias("cut"), (F.col("nth") - F.col("_upto") + F.col("times")).alias("tied"), "times")
    made = plan.join(cut, ["rank", "size"], "left").withColumn("whole", F.col("more") >= F.col("n"))
    return stage(made.select(_key("source").alias("_key"), "size", "source_size", "target", "base", "whole", "cut", "tied", "times"), "mix-cuts")


def _copies(rows: DataFrame, times: Column, piece: int = 4096) -> DataFrame:
    """Every row as often as ``times`` says; a row with very many copies is spread over tasks before they are made."""
    first, here = fresh(rows, "first_copy", "copy")
    spread = rows.withColumn(here, times.cast("long")).filter(F.col(here) > 0)
    spread = spread.withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(here) - 1, F.lit(piece).cast("long"))))
    few = F.least(F.col(here) - F.col(first), F.lit(piece).cast("long")).cast("int")
    return spread.withColumn(here, few).repartition(first).withColumn(first, F.explode(F.array_repeat(F.lit(0), F.col(here)))).drop(first, here)


def decide(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own (the last); documents of size 0 are never
    taken. Of rows that are equal in doc_id, text and source, as many are taken once more as the target leaves: which of
    them makes no difference. An empty table gives an empty result; other columns are ignored. A source's lengths, not its
    documents, meet in one task: there are at most about sqrt(2 x words) different ones. One length of one source may hold
    a third of all documents, and one row may be repeated so often: equal rows are counted first, their order is cut into
    ranges of about RANK_ROWS by their hash, and only the range that holds the cut is ranked."""
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _place(seed).alias("at"))
    slim = stage(slim, "mix-slim")
    cuts = _cuts(slim, weights, share, repeats)
    rows = slim.withColumn("_key", _key("source")).join(cuts, ["_key", "size"])
    before = F.coalesce(F.col("at") < F.col("cut"), F.lit(False))
    tie = F.coalesce(F.col("at") == F.col("cut"), F.lit(False))
    taken = lambda times: ((F.col("base") + times) * F.col("size")).alias("taken")
    names = ["doc_id", "size", "source_size", "target"]
    plain = rows.filter(~tie).select(*names, taken(F.when(F.col("whole") | before, 1).otherwise(0)))
    tied = rows.filter(tie).groupBy(*names, "base", "tied", "times").agg(F.count("*").alias("_n"))
    each = F.explode(F.array(F.struct(F.lit(1).alias("more"), F.col("tied").alias("n")), F.struct(F.lit(0).alias("more"), (F.col("times") - F.col("tied")).alias("n"))))
    tied = tied.select(*names, "base", each.alias("_e"))
    tied = _copies(tied, F.col("_e.n")).select(*names, taken(F.col("_e.more")))
    return plain.unionByName(tied)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as many times as it is taken; see ``decide``. Of rows that share id and text
    but differ in other columns, the choice goes by a hash of all columns."""
    named = list(docs.columns)
    slim = stage(docs.select("source", size_of(F.col("text")).alias("size"), _place(seed, *named).alias("at")), "mix-slim")
    own = ["_key", "size", "base", "whole", "cut", "tied", "times"]
    key, size, base, whole, cut, tied, times = fresh(docs, "key", "words", "base", "whole", "cut", "tied", "times")
    cuts = _cuts(slim, weights, share, repeats).select(*[F.col(c).alias(n) for c, n in zip(own, (key, size, base, whole, cut, tied, times))])
    (at,) = fresh(docs, "at")
    rows = docs.withColumns({key: _key("source"), size: size_of(F.col("text")), at: _place(seed, *named)}).filter(F.col(size) > 0)
    rows = rows.join(cuts, [key, size])
    before = F.coalesce(F.col(at) < F.col(cut), F.lit(False))
    tie = F.coalesce(F.col(at) == F.col(cut), F.lit(False))
    columns = [F.col(f"`{c}`") for c in named]
    # Rows at the cut that are alone there are decided with the others; only repeated ones meet, as counts.
    single = F.coalesce(F.col(times) == 1, F.lit(True))
    more = F.when(F.col(whole) | before | (tie & single), 1).otherwise(0)
    plain = rows.filter(~tie | single).withColumn(size, F.explode(F.array_repeat(F.lit(1).cast("long"), (F.col(base) + more).cast("int")))).select(*columns)
    shared = rows.filter(tie & ~single).groupBy(key, size, base, tied, times).agg(F.any_value(F.struct(*columns)).alias(at))
    shared = _copies(shared, F.col(base) * F.col(times) + F.col(tied)).select(F.col(f"{at}.*"))
    return plain.unionByName(shared)

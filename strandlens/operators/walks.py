"""Walks along long sequences, worked in parallel pieces.

A walk's state on entering a piece is one of a few offsets, so a piece is a function: from the offset of entry to the offset
in the next piece. Functions of neighbouring pieces are composed by groups, those of groups again, until one is left; then
entries are handed down the same tree. No task sees more than FAN functions of a group, and there are as many rounds as the
tree has levels.

Within a piece the walk is a graph of jumps from place to place, followed by pointer doubling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import _column
from ..sources.sinks import stage

FAN = 64
CHUNK_ROWS = 1 << 20  # places of whole pieces that a step looks at together, about


def chain_entries(tables: DataFrame, group: Sequence[str], width: int, restart: bool) -> DataFrame:
    """(group, _piece, _entry): the offset at which a walk enters each piece.

    ``tables``: the group, ``_piece`` (0, 1, ...) and ``_leave``, which lists per offset of entry (fewer than ``width``) the
    offset in the next piece, -1 where the walk ends. A piece whose predecessor is missing is entered at 0 with ``restart``;
    without, only piece 0 is, and pieces behind the end of the walk are left out."""
    cols = [_column(g) for g in group]
    level = stage(tables.select(*cols, F.col("_piece").cast("bigint").alias("_piece"), "_leave"), "walk-tables")
    most = level.agg(F.max("_piece")).first()[0]
    if most is None:
        return level.select(*cols, "_piece", F.lit(0).alias("_entry"))
    lost = F.lit(0 if restart else -1)
    begin = F.col("_node") * FAN

    def entry(state: Column, kid: Column) -> Column:
        return F.when(kid["_piece"] == state["at"], state["o"]).otherwise(lost)

    def through(state: Column, kid: Column) -> list[Column]:
        e = entry(state, kid)
        # An offset that a table doesn't list (piece 0 is entered at 0 only) ends the walk.
        out = F.coalesce(F.when(e >= 0, F.get(kid["_leave"], e)), F.lit(-1))
        return [(kid["_piece"] + 1).alias("at"), out.alias("o")]

    def composed(offset: Column) -> Column:
        opening = F.struct(begin.alias("at"), offset.alias("o"))
        leave = lambda s: F.when(s["at"] == begin + FAN, s["o"]).otherwise(lost)
        return F.aggregate("_kids", opening, lambda s, kid: F.struct(*through(s, kid)), leave)

    nodes = []
    while True:
        held = level.groupBy(*cols, F.floor(F.col("_piece") / FAN).cast("bigint").alias("_node")).agg(
            F.sort_array(F.collect_list(F.struct("_piece", "_leave"))).alias("_kids")
        )
        nodes.append(stage(held, "walk-nodes"))
        most //= FAN
        if not most:
            break
        leave = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), composed)
        level = nodes[-1].select(*cols, F.col("_node").alias("_piece"), leave.alias("_leave"))

    def enter(state: Column, kid: Column) -> Column:
        listed = F.array(F.struct(kid["_piece"].alias("_piece"), entry(state, kid).alias("_entry")))
        return F.struct(*through(state, kid), F.concat(state["kids"], listed).alias("kids"))

    none = F.expr("cast(array() as array<struct<_piece: bigint, _entry: int>>)")
    entries = None
    for held in reversed(nodes):
        held = held.withColumn("_entry", F.lit(0)) if entries is None else held.join(entries, [*group, "_node"])
        opening = F.struct(begin.alias("at"), F.col("_entry").alias("o"), none.alias("kids"))
        kids = F.aggregate("_kids", opening, enter, lambda s: s["kids"])
        found = held.select(*cols, F.explode(kids).alias("_kid")).select(*cols, "_kid.*").filter("_entry >= 0")
        entries = found.withColumnRenamed("_piece", "_node")
    return found


def terminals(jump: np.ndarray) -> np.ndarray:
    """Where each place's walk ends. ``jump``: the next place, ahead of it; its own number at an end."""
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def visits(jump: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of the walks from ``starts``, in order. ``jump``: the next place; the number of places beyond the end.

    After k doublings, jumps are 2**k places wide, and what they reach from the 2**k places known so far is the rest up to
    2**(k + 1)."""
    n = len(jump)
    jump = np.append(jump, n)
    found = starts[starts < n]
    while True:
        more = jump[found]
        more = more[more < n]
        if not len(more):
            return np.unique(found)
        found = np.concatenate([found, more])
        jump = jump[jump]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _opens(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Whether a row is the first of its piece; rows of a piece are neighbours."""
    opens = np.ones(len(table), bool)
    if len(table):
        opens[1:] = False
        for c in by:
            codes = _codes(table.column(c))
            opens[1:] |= codes[1:] != codes[:-1]
    return opens


Weigh = Callable[[pa.Table | pa.RecordBatch], np.ndarray]


def _parted(table: pa.Table, by: Sequence[str], weigh: Weigh, limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    opens = _opens(table, by)
    first = np.flatnonzero(opens)
    if not len(first):
        return
    weight = np.add.reduceat(weigh(table), first)
    part = (np.cumsum(weight) - weight) // limit
    cuts = [*first[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(table)]
    for i, j in zip(cuts, cuts[1:]):
        yield table.slice(i, j - i), np.cumsum(opens[i:j]) - 1


def whole_pieces(batches: Iterator[pa.RecordBatch], by: Sequence[str], weigh: Weigh, limit: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pieces with the number of each row's piece in it; together they weigh ``limit`` and one piece more at most.
    ``weigh`` gives the weight of each row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(weigh(batch).sum())
        if size >= limit:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_opens(table, by))[-1])
            if last:
                yield from _parted(table.slice(0, last), by, weigh, limit)
                table = table.slice(last)
            held, size = table.to_batches(), 0
    if held:
        yield from _parted(pa.Table.from_batches(held), by, weigh, limit)


class Spaced:
    """Walks over allowed places of several pieces at once, each step at least ``window`` on.

    ``piece`` numbers the piece of each run of neighbouring allowed places, from ``first`` to ``last`` in it (none where
    last < first); runs are in order. Places go from 0 to ``size`` - 1 in a piece."""

    def __init__(self, piece: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, window: int):
        count = last - first + 1
        self.run = np.repeat(np.arange(len(piece)), count)
        self.place = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.stride, self.size, self.window = size + window, size, window
        self.key = piece[self.run] * self.stride + self.place
        self.jump = self._at(piece[self.run], self.place + window)

    def _at(self, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first allowed place of the piece from here on; the number of all places where there is none."""
        found = np.searchsorted(self.key, piece * self.stride + place)
        inside = np.append(self.key, -1)[found] // self.stride == piece
        return np.where(inside, found, len(self.key))

    def picked(self, piece: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Indices into ``place`` and ``run`` of the places visited."""
        return visits(self.jump, self._at(piece, entry))

    def leaves(self, pieces: np.ndarray) -> np.ndarray:
        """Per piece and offset of entry, the offset in the next piece."""
        n = len(self.key)
        ends = terminals(np.where(self.jump == n, np.arange(n), self.jump))
        entry = np.tile(np.arange(self.window), len(pieces))
        at = self._at(np.repeat(pieces, self.window), entry)
        left = np.zeros(len(at), np.int64)
        left[at < n] = np.maximum(self.place[ends[at[at < n]]] + self.window - self.size, 0)
        return left.reshape(len(pieces), self.window)

"""Weighted finite-state transducers as data: states, arcs and weights, composition, and the best path.

Weights add along a path, and of several paths the heaviest counts."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass

State = Hashable


@dataclass(frozen=True)
class Arc:
    reads: str
    writes: str
    weight: float
    to: State


@dataclass(frozen=True)
class Transducer:
    """``arcs`` of each state; paths begin in ``initial`` and end in one of ``finals``. An arc reads one symbol and writes one."""

    initial: State
    finals: frozenset[State]
    arcs: dict[State, tuple[Arc, ...]]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of what ``first`` writes. States are pairs; only pairs that can be reached are kept."""
    initial = (first.initial, second.initial)
    arcs: dict[State, tuple[Arc, ...]] = {}
    open_ = [initial]
    while open_:
        state = open_.pop()
        if state in arcs:
            continue
        a, b = state
        arcs[state] = tuple(
            Arc(x.reads, y.writes, x.weight + y.weight, (x.to, y.to))
            for x in first.arcs.get(a, ()) for y in second.arcs.get(b, ()) if x.writes == y.reads
        )
        open_ += [arc.to for arc in arcs[state]]
    finals = frozenset(s for s in arcs if s[0] in first.finals and s[1] in second.finals)
    return Transducer(initial, finals, arcs)


class Runner:
    """Best paths of a transducer. Its arcs are listed by state number and symbol once."""

    def __init__(self, machine: Transducer):
        number = {s: i for i, s in enumerate(machine.arcs)}
        self.initial = number[machine.initial]
        self.finals = {number[s] for s in machine.finals}
        self.by: list[dict[str, list[tuple[str, float, int]]]] = [{} for _ in number]
        for state, arcs in machine.arcs.items():
            for arc in arcs:
                self.by[number[state]].setdefault(arc.reads, []).append((arc.writes, arc.weight, number[arc.to]))

    def best(self, symbols: Sequence[str], scale: Sequence[float]) -> tuple[float, list[str]] | None:
        """Weight and writing of the heaviest path that reads ``symbols``, an arc's weight times the symbol's ``scale``; among
        equals the first found. None where no path reads them."""
        held: dict[int, float] = {self.initial: 0.0}
        back: list[dict[int, tuple[int, str]]] = []
        for symbol, times in zip(symbols, scale):
            reached: dict[int, float] = {}
            came: dict[int, tuple[int, str]] = {}
            for state, weight in held.items():
                for writes, more, to in self.by[state].get(symbol, ()):
                    total = weight + more * times
                    if to not in reached or total > reached[to]:
                        reached[to] = total
                        came[to] = state, writes
            held = reached
            back.append(came)
        ends = [s for s in held if s in self.finals]
        if not ends:
            return None
        state = max(ends, key=held.__getitem__)
        weight, out = held[state], []
        for came in reversed(back):
            state, writes = came[state]
            out.append(writes)
        return weight, out[::-1]


def paths(machine: Transducer, symbols: Sequence[str]) -> Iterator[tuple[list[Arc], State]]:
    """All paths that read ``symbols``, however many."""

    def walk(state: State, at: int) -> Iterator[tuple[list[Arc], State]]:
        if at == len(symbols):
            if state in machine.finals:
                yield [], state
            return
        for arc in machine.arcs.get(state, ()):
            if arc.reads == symbols[at]:
                for rest, end in walk(arc.to, at + 1):
                    yield [arc, *rest], end

    return walk(machine.initial, 0)

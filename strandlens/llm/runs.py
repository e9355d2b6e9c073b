"""Periodic runs of words by a suffix automaton with link-cut access.

Every prefix of a text has its path to the root of the automaton's tree of suffix links. When the path of the i-th prefix is
accessed, it falls into segments that were last coloured by earlier prefixes; where prefix j coloured a segment whose
deepest state holds strings of up to L words, these L words end at j and again at i. With d = i - j and L >= d that is a square
of period d, and its L + d words can't be extended to the left. Then the whole path takes the colour i. The path's segments are
kept as the preferred paths of a link-cut tree, so all accesses together take n log n steps.

Only stretches that repeat words within themselves can hold a run, so a first look by hashes finds these stretches,
and the automaton is built of each. A run lies within one of them, whole."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import blocks, map_batches, texts_only
from .hashing import Ranges, mix, words

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
Run = tuple[int, int, int]  # start, length, period


def _automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state its longest string's length and its suffix link, and the state of each prefix."""
    length, link, step = [0], [-1], [{}]
    last, prefix = 0, []
    for c in text:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
        prefix.append(state)
    return length, link, prefix


class Paths:
    """A rooted tree under access: ``access(v, colour)`` yields the (colour, deepest node) of the segments of v's path to
    the root, from v up, and gives the path that colour. Segments are preferred paths, each one splay tree by depth."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)  # parent in the splay tree, or of the path's top where the node is the splay tree's root
        self.shallow, self.deep = [-1] * n, [-1] * n  # children in the splay tree
        self.colour = [-1] * n  # of the path, held at the splay tree's root

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            inner = deep[x]
            shallow[p], deep[x] = inner, p
        else:
            inner = shallow[x]
            deep[p], shallow[x] = inner, p
        if inner >= 0:
            up[inner] = p
        if g >= 0:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, shallow, deep, colour = self.up, self.shallow, self.deep, self.colour
        while True:
            p = up[x]
            if p < 0 or (shallow[p] != x and deep[p] != x):
                return
            g = up[p]
            root = g < 0 or (shallow[g] != p and deep[g] != p)
            if root:
                colour[x] = colour[p]
            else:
                g_up = up[g]
                if g_up < 0 or (shallow[g_up] != g and deep[g_up] != g):
                    colour[x] = colour[g]
                self._rotate(p if (shallow[p] == x) == (shallow[g] == p) else x)
            self._rotate(x)

    def access(self, v: int, colour: int) -> Iterator[tuple[int, int]]:
        below, x = -1, v
        while x >= 0:
            self._splay(x)
            had = self.colour[x]
            cut = self.deep[x]
            if cut >= 0:
                self.colour[cut] = had
            self.deep[x] = below
            if had >= 0:
                yield had, x
            below, x = x, self.up[x]
        self.colour[below] = colour


def runs_of(text: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All maximal stretches with smallest period q and length of at least ``least`` and ``times`` (2 or more) q, by start, then
    period. Text: words as numbers, equal where the words are.

    A run is found where it ends: its last words minus one period occurred one period before, and nowhere later, or the period
    would not be the smallest."""
    length, link, prefix = _automaton(text)
    paths, n, out = Paths(link), len(text), []
    for i, state in enumerate(prefix):
        for j, deepest in paths.access(state, i):
            d, again = i - j, length[deepest]
            if again >= (times - 1) * d and again + d >= least and (i + 1 == n or text[i + 1] != text[i + 1 - d]):
                out.append((i - again - d + 1, again + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(hashes: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of words that hold every run. In a run, words repeat one period on over at
    least ``gram`` words, so gram words from each of its places or up to them occur twice in the stretch. Stretches
    of such places are looked at again by themselves until none shrinks."""
    gram = min(-(-least * (times - 1) // times), least - 1)
    begin, end = first[:-1], first[1:]
    if len(hashes) < gram + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = Ranges.over(mix(hashes)).fixed(gram)
    while True:
        long = end - begin >= least
        begin, end = begin[long], end[long]
        n = end - begin - gram + 1
        if not len(begin):
            return begin, end
        of = np.repeat(np.arange(len(begin)), n)
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = mix(grams[at] + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at, of = at[twice], of[twice]
        opens = np.ones(len(at), bool)
        opens[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + gram)
        where = np.flatnonzero(opens)
        now = at[where], at[np.append(where[1:], len(at)) - 1] + gram if len(at) else at
        if len(now[0]) == len(begin) and (now[0] == begin).all() and (now[1] == end).all():
            return begin, end
        begin, end = now


Edit = Callable[[int | None, int], tuple[int, int] | None]


def looped(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """For a tenth of the documents with words (by the CRC of the id) a place a and a period p: from a on, its words are the p
    words at a again and again. None leaves the document as it is, also one without id."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def _found(docs: DataFrame, schema: str, row: Callable, edit: Edit | None, least: int, times: int) -> DataFrame:
    """A row per document: ``row(words, runs)`` as a dict, beside doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, i, j, data, offsets in blocks(batches):
            hashes, _, first = words(data, offsets, lower=False)
            ids = batch.column("doc_id")[i:j]
            edits = {}
            if edit:
                for k, (doc, a, b) in enumerate(zip(ids.to_pylist(), first[:-1].tolist(), first[1:].tolist())):
                    if (made := edit(doc, b - a)) is not None:
                        edits[k] = at, period = made
                        hashes[a + at : b] = np.resize(hashes[a + at : a + at + period], b - a - at)
            begin, end = _stretches(hashes, first, least, times)
            of = np.searchsorted(first, begin, "right") - 1
            held: dict[int, list[tuple[int, int]]] = {}
            for k, s, e in zip(of.tolist(), (begin - first[of]).tolist(), (end - first[of]).tolist()):
                held.setdefault(k, []).append((s, e))
            rows = []
            for k in range(j - i):
                said = data[offsets[k] : offsets[k + 1]].tobytes().split()
                if k in edits:
                    at, period = edits[k]
                    n = len(said) - at
                    said[at:] = (said[at : at + period] * (n // period + 1))[:n]
                found = []
                for s, e in held.get(k, ()):
                    number: dict[bytes, int] = {}
                    found += [(s + a, b, p) for a, b, p in runs_of([number.setdefault(w, len(number)) for w in said[s:e]], least, times)]
                rows.append(row(said, found))
            yield {"doc_id": ids} | {c: [r[c] for r in rows] for c in rows[0]}

    return map_batches(texts_only(docs), f"doc_id long, {schema}", run)


def kept_words(said: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return said
    edge = np.zeros(len(said) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [said[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id and runs, an array of (start, length, period) in words; empty without any. See ``report``."""
    schema = "runs array<struct<start: long, length: long, period: long>>"
    as_row = lambda said, found: {"runs": [dict(zip(("start", "length", "period"), r)) for r in found]}
    return _found(docs, schema, as_row, None, least, times)


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id and text, its words without those that repeat a run's first period, joined by one space. Texts
    without a run keep their words, too, joined by one space."""
    as_row = lambda said, found: {"text": b" ".join(kept_words(said, found)).decode()}
    return _found(docs, "text string", as_row, None, least, times)


def _digest(said: list[bytes], found: list[Run]) -> dict:
    best = None
    for r in found:  # by start, then period: only a greater exponent wins
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    start, length, period = best or (None,) * 3
    return {
        "n_runs": len(found), "start": start, "length": length, "period": period,
        "exponent_milli": 1000 * length // period if best else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(kept_words(said, found))).hexdigest(),
    }


def report(docs: DataFrame, edit: Edit | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest exponent (ties: the
    smallest start, then period; null without runs), and digests of all runs and of the collapsed text.

    Words are byte strings between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns, told apart
    exactly. Null and empty texts have no words and no runs; repeated rows are looked at each; null ids are kept; other
    columns are ignored; an empty table gives an empty result. Nothing is shuffled. A text is held whole by its task, and
    a stretch with repeats takes some 500 bytes a word."""
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _found(docs, schema, _digest, edit, least, times)

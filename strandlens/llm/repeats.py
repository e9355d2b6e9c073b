"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over PARSE of the width marks triggers, and triggers cut texts into phrases: a start's trigger is the place
of the smallest hash within its string. Since that depends on the string only, a repeated string is cut the same way
wherever it occurs, every string has a trigger, and there are few of them. A start of a string of ``width`` bytes is then (a suffix of
a phrase, the text from its trigger on), which is how suffixes of the dictionary and of the parse combine into the
order of the corpus. Two starts are equal where both parts are. So the order is refined in three steps, each
on what the step before left undecided:

1. the parse: phrases, cut at fixed distances from the trigger, are grouped by the text around it that all their starts
   share; groups of one are unique,
2. the dictionary: in groups of several, a whole phrase with all text that its starts reach, if it occurs twice, settles
   all its starts; a group of equal phrases is settled,
3. the rest, groups of different phrases before equal text: single starts are ordered by their own strings.

Equal ranks are all that is needed from the order, so ranks are hashes: no suffix array has to be held by one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import blocks, combine, fresh, map_batches, stage, texts_only
from .hashing import Ranges, mix, signed, word_bounds, words

WIDTH = 400
PASSAGE = 51  # words
PARSE = 0.3  # share of the width that the text after a trigger takes
PIECES = 3  # a phrase is cut in so many at most
# A place is one integer: the first start in a text, whether starts are words, number of starts. The text is the 64-bit hash of its doc_id and text.
_N_BITS = 9
_N = 1 << _N_BITS


def _reach(width: int) -> tuple[int, int]:
    """The longest suffix of a phrase that counts as anchored at its trigger, and how much text from the trigger on
    is common to all starts anchored there."""
    parse = max(1, int(PARSE * width))
    return width - parse, parse


def _phrases(ranges: Ranges, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Keys of phrases, their triggers, first and last starts, and rows. A start's trigger is the first of the smallest
    hashes (32 bits) of ``parse`` bytes that lie within its string; a phrase's key is the hash of what all starts at
    its distance from a trigger share."""
    reach, parse = _reach(width)
    begin, last = offsets[:-1], offsets[1:] - width  # of a row's starts
    long = last >= begin
    if not long.any():
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    low = ranges.fixed(parse)
    low = low >> np.uint64(32) << np.uint64(32) | np.arange(len(low), dtype=np.uint64)
    step = 1
    while 2 * step <= reach + 1:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if rest := reach + 1 - step:
        low = np.minimum(low[:-rest], low[rest:])
    edge = np.zeros(len(low) + 1, np.int8)
    edge[begin[long]] += 1
    edge[last[long] + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    trigger = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.ones(len(at), bool)
    size = -(-(reach + 1) // PIECES)
    piece = (trigger - at) // size
    opens[1:] = (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(opens)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    trigger, piece = trigger[first], piece[first]
    shared = trigger - piece * size
    key = mix(ranges.of(shared, shared - size + 1 + width) + piece.astype(np.uint64))
    return key, trigger, lo, hi, np.searchsorted(offsets, lo, "right") - 1


ROWS = "key long, weight int, phrase long, whole long, of long, place long"


def _pack(start: np.ndarray, n: np.ndarray, unit: int) -> np.ndarray:
    return start << (_N_BITS + 1) | unit << _N_BITS | n


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First starts, how many, and their units."""
    return place >> (_N_BITS + 1), place & _N - 1, place >> _N_BITS & 1


def _rows(ids: pa.Array, rows: np.ndarray, place: np.ndarray, key: np.ndarray, weight: np.ndarray, hubs: np.ndarray, phrase: np.ndarray | None = None, whole: np.ndarray | None = None) -> dict:
    n, pad = len(key), len(hubs)
    fill = lambda x, kind=None: pa.concat_arrays([pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()), pa.nulls(pad, pa.int64())])
    return {
        "key": signed(np.concatenate([key, hubs])), "weight": np.concatenate([weight, np.full(pad, 2, np.int8)]).astype(np.int32),
        "phrase": fill(None if phrase is None else signed(phrase)), "whole": fill(None if whole is None else signed(whole)),
        "of": ids.take(fill(rows)), "place": fill(place),
    }


def _units(data: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, int, Ranges, np.ndarray]]:
    """Per unit (0 bytes, 1 words): unit, width, hashes of ranges, rows' offsets. Words are equal byte for byte, whatever
    space parts them."""
    yield 0, widths[0], Ranges(data), offsets
    if len(widths) > 1:
        hashes, _, first = words(data, offsets, lower=False)
        yield 1, widths[1], Ranges.over(hashes), first


def _spread(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key)


def _runs_of(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring starts begin, and how long they are."""
    opens = np.ones(len(at), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
    opens[:: _N - 1] = True  # a run's length must fit its field
    first = np.flatnonzero(opens)
    return first, np.diff(np.append(first, len(at)))


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _send_phrases(key: np.ndarray, whole: np.ndarray, ids: pa.Array, rows: np.ndarray, start: np.ndarray, n: np.ndarray, unit: int) -> Iterator[dict]:
    """Phrases under their key. Two of those with the same whole settle it: more of them within the chunk go as runs of starts."""
    order = np.argsort(whole, kind="stable")
    rank = np.arange(len(whole))
    rank -= np.searchsorted(whole[order], whole[order])
    more = np.zeros(len(whole), bool)
    more[order] = rank >= 2
    one = ~more
    place = _pack(start[one], n[one], unit)
    sent, weight, hubs = combine(key[one], _spread(key[one], place))
    yield _rows(ids, rows[one], place, sent, weight, hubs, key[one], whole[one])
    row, at = np.repeat(rows[more], n[more]), _expand(start[more], n[more])
    first, length = _runs_of(row, at)
    spread = _spread(np.repeat(whole[more], n[more])[first], at[first])
    yield _rows(ids, row[first], _pack(at[first], length, unit), spread, np.full(len(first), 2, np.int8), hubs[:0])


def _send_starts(key: np.ndarray, ids: pa.Array, rows: np.ndarray, at: np.ndarray, settled: np.ndarray, unit: int) -> dict:
    """Single starts under their key. Those that repeat within the chunk are known to be repeated: neighbours among them are
    merged to runs. settled: keys that are known to be repeated and stand for no row."""
    every = np.concatenate([key, np.repeat(settled, 2)])
    _, weight, hubs = combine(every, every)
    known = weight[: len(key)] == 2
    i = np.flatnonzero(known)
    first, length = _runs_of(rows[i], at[i])
    run, one = i[first], np.flatnonzero(~known)
    place = np.concatenate([_pack(at[one], 1, unit), _pack(at[run], length, unit)])
    sent = np.concatenate([key[one], _spread(key[run], at[run])])
    weights = np.concatenate([np.ones(len(one), np.int8), np.full(len(run), 2, np.int8)])
    return _rows(ids, np.concatenate([rows[one], rows[run]]), place, sent, weights, hubs)


def _parse(docs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """A row per phrase, under the hash of the text that its starts share (whole: the hash of all that they reach), and rows
    without a phrase for starts known to be repeated. place: the first start, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, i, j, data, offsets in blocks(batches):
            for unit, width, ranges, first in _units(data, offsets, widths):
                key, marks, lo, hi, rows = _phrases(ranges, first, width)
                whole = mix(ranges.of(lo, hi + width) + (marks - lo).astype(np.uint64))
                yield from _send_phrases(key, whole, batch.column("of")[i:j], rows, lo - first[rows], hi - lo + 1, unit)

    return map_batches(docs, ROWS, run)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose key is repeated: at most one row per key and task chunk meets here, however hot a key is."""
    times = F.sum("weight").over(Window.partitionBy("key"))
    return rows.withColumn("_times", times).filter("_times >= 2 and place is not null").drop("_times", "key", "weight")


def _starts(docs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """A row per start of the phrases listed in ``open`` (place, and how often the whole occurs), under its string's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, i, j, data, offsets in blocks(batches):
            listed = batch.column("open")[i:j]
            rows = np.repeat(np.arange(j - i), np.diff(listed.offsets.to_numpy()))
            flat = listed.flatten()
            often = flat.field("often").to_numpy()
            start, n, units = _unpack(flat.field("place").to_numpy())
            for unit, width, ranges, first in _units(data, offsets, widths):
                mine = units == unit
                count = n[mine]
                row, at = np.repeat(rows[mine], count), _expand(start[mine], count)
                begin = at + first[row]
                key = mix(ranges.of(begin, begin + width))
                once = np.repeat(often[mine], count) == 1
                yield _send_starts(key[once], batch.column("of")[i:j], row[once], at[once], key[~once], unit)

    return map_batches(docs, ROWS, run)


def _runs(docs: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Per text: of (its hash) and runs: the places of starts of repeated strings."""
    live = stage(_repeated(_parse(docs.select("of", "text"), widths)), "repeats-live")
    free = live.filter("phrase is null").select("of", "place")
    phrases = live.filter("phrase is not null")
    wholes = phrases.groupBy("phrase", "whole").agg(F.count("*").alias("often"), F.min(F.struct("of", "place")).alias("one"))
    wholes = stage(wholes, "repeats-wholes")
    settled = phrases.join(wholes.filter("often > 1").select("phrase", "whole"), ["phrase", "whole"], "left_semi").select("of", "place")
    several = wholes.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1").select("phrase")
    open_ = wholes.join(several, "phrase", "left_semi").select("one.*", "often")
    open_ = open_.groupBy("of").agg(F.collect_list(F.struct("place", "often")).alias("open"))
    rows = open_.join(docs.select("of", "text"), "of").select("of", "text", "open")
    single = _repeated(_starts(rows, widths)).select("of", "place")
    every = free.unionByName(settled).unionByName(single)
    return stage(every.groupBy("of").agg(F.collect_set("place").alias("runs")), "repeats-runs")


def _removed(data: np.ndarray, runs: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Which bytes go, and in how many maximal runs."""
    size = len(data)
    edge = np.zeros(size + 1, np.int32)
    start, n, units = _unpack(runs)
    end = start + n - 1 + np.array(widths)[units]
    if units.any():
        by_word = units == 1
        begins, ends = word_bounds(data, np.array([0, size]))
        start[by_word], end[by_word] = begins[start[by_word]], ends[end[by_word] - 1]
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if size else 0


def _joined(docs: DataFrame, widths: tuple[int, ...]) -> tuple[DataFrame, str]:
    """``docs`` with a column of runs, and that column's name."""
    if any(not 1 <= w or _reach(w)[0] + 1 >= _N for w in widths):
        raise ValueError("width must be from 1 to 728 bytes or words")
    runs_name, text_of, run_of = fresh(docs, "runs", "text_of", "run_of")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn(text_of, F.xxhash64("doc_id", text))
    runs = _runs(held.select(F.col(text_of).alias("of"), text.alias("text")), widths)
    runs = runs.select(F.col("of").alias(run_of), F.col("runs").alias(runs_name))
    joined = held.join(runs, F.col(text_of) == F.col(run_of), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], runs_name), runs_name


def report(docs: DataFrame, width: int = WIDTH, keep_text: bool = False, passage: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, then (passage) n_cut, and (keep_text) text: what is left (bytes of
    characters that a cut splits left out). Removed is each byte of a string of ``width`` bytes that starts
    at another place of the table too (in the same document included, overlapping included). Where ``passage`` is given, text is cut as by
    ``remove``, by passages of so many words as well, and n_cut counts these bytes; the columns before are by ``width`` alone.

    Null and empty texts have nothing to remove; a row that repeats another repeats all its strings; rows of one
    doc_id and different texts are separate (told apart by a 64-bit hash of both), null ids are kept, other columns are ignored,
    an empty table gives an empty result. Texts of any length are cut into places, so only a text itself has to fit a task."""
    widths = (width,) if passage is None else (width, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes, removed, spans, digests, cut, left = [], [], [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                data = text.as_buffer()
                size = data.size
                n, s, c, kept, rest = 0, 0, 0, data, data
                if runs.is_valid and size:
                    whole, places = np.frombuffer(data, np.uint8), runs.values.to_numpy(zero_copy_only=False)
                    gone, s = _removed(whole, places[_unpack(places)[2] == 0], (width,))
                    n = int(gone.sum())
                    kept = rest = whole[~gone].tobytes()
                    if passage is not None:
                        gone, _ = _removed(whole, places, widths)
                        c, rest = int(gone.sum()), whole[~gone].tobytes() if keep_text else b""
                sizes.append(size)
                removed.append(n)
                spans.append(s)
                digests.append(hashlib.sha256(kept).hexdigest())
                cut.append(c)
                if keep_text:
                    left.append(bytes(rest).decode(errors="ignore"))
            yield {
                "doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_removed": removed, "n_spans": spans, "kept_sha256": digests,
                **({"n_cut": cut} if passage is not None else {}), **({"text": left} if keep_text else {}),
            }

    joined, _ = _joined(texts_only(docs), widths)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(joined, schema + ", n_cut long" * (passage is not None) + ", text string" * keep_text, run)


def remove(docs: DataFrame, width: int = WIDTH, passage: int | None = None) -> DataFrame:
    """``docs`` with text cut by the bytes that ``report`` counts and, where ``passage`` is given, by every passage of so many
    words that starts at another word of the table too, from its first word to its last; bytes of characters that a cut splits go too, and n_chars,
    where there is such a column, follows. No row goes: a text of repeats only is left empty, a null one null."""
    names = docs.columns
    widths = (width,) if passage is None else (width, passage)
    joined, runs_name = _joined(docs, widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text"), batch.column(runs_name)):
                if runs.is_valid and text.is_valid:
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    gone, _ = _removed(data, runs.values.to_numpy(zero_copy_only=False), widths)
                    texts.append(data[~gone].tobytes().decode(errors="ignore"))
                else:
                    texts.append(text.as_py())
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                old, cut = batch.column("n_chars"), batch.column(runs_name)
                counts = [len(t) if c.is_valid and t is not None else o.as_py() for t, o, c in zip(texts, old, cut)]
                made["n_chars"] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return joined.mapInArrow(run, docs.schema)

"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over 7 bytes ends a chunk where its low bits are all ones; each chunk becomes one of 64 signs. The block
size is the smallest power of two that gives at most 64 chunks, and a second signature at twice that size lets
fingerprints of neighbouring block sizes be compared. Likeness is one minus the relative edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import BLOCK_BYTES, map_batches, stage, texts_only
from .hashing import Ranges

ROLL = 7
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "S1")
CHUNKS = 64
COMMON = 7  # signs in a row that two signatures must share, else their likeness is 0


def fingerprints(texts: list[bytes]) -> list[str]:
    """``block:signature:signature at twice the block`` of each text; of the empty one ``1::``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    ranges = Ranges(data)
    roll = np.zeros(len(data), np.uint64)
    if len(data) >= ROLL:
        roll[ROLL - 1 :] = ranges.fixed(ROLL)
    out = []
    for text, end in zip(texts, ends):
        start = int(end) - len(text)
        if not text:
            out.append("1::")
            continue
        head = np.arange(start, min(start + ROLL - 1, int(end)))
        if len(head):
            roll[head] = ranges.of(np.full(len(head), start), head + 1)
        own = roll[start : int(end)]
        level = max(0, (len(text) // CHUNKS).bit_length() - 1)
        # Chunk ends are nested: those of a block size are among those of the half of it.
        while level:
            lower = np.flatnonzero((own & np.uint64((1 << (level - 1)) - 1)) == np.uint64((1 << (level - 1)) - 1))
            if len(lower) > CHUNKS - 1:
                break
            level -= 1
        cuts = np.flatnonzero((own & np.uint64((1 << level) - 1)) == np.uint64((1 << level) - 1))
        while len(cuts) > CHUNKS - 1 and level < 62:
            level += 1
            cuts = cuts[(own[cuts] & np.uint64((1 << level) - 1)) == np.uint64((1 << level) - 1)]
        twice = cuts[(own[cuts] & np.uint64((2 << level) - 1)) == np.uint64((2 << level) - 1)]
        signatures = []
        for c in (cuts, twice):
            bounds = np.unique(np.concatenate([[start], start + c + 1, [int(end)]]))
            signatures.append(SIGNS[(ranges.of(bounds[:-1], bounds[1:]) >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        out.append(f"{1 << level}:{signatures[0]}:{signatures[1]}")
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, one machine word of the shorter side at a time (bit-parallel)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        h = down | (~(eq | up) & full)
        down_h = up & eq
        if h & last:
            distance += 1
        elif down_h & last:
            distance -= 1
        h = (h << 1 | 1) & full
        down_h = (down_h << 1) & full
        up = down_h | (~(x | h) & full)
        down = h & x
    return distance


def _close(a: str, b: str) -> float:
    if a == b:
        return 1.0
    gram = max(1, min(COMMON, len(a) // 2, len(b) // 2))
    if not a or not b or not {a[i : i + gram] for i in range(len(a) - gram + 1)} & {b[i : i + gram] for i in range(len(b) - gram + 1)}:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1. Fingerprints whose block sizes differ by more than a factor of two are 0; equal ones are 1."""
    (n, a, b), (m, c, d) = one.split(":"), other.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_close(a, c), _close(b, d)) if a or c else 1.0
    if n == 2 * m:
        return _close(a, d)
    return _close(b, c) if m == 2 * n else 0.0


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], following: list[str]) -> dict:
    """The result rows of ``texts``; following: the next document's text of each."""
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)]
    plain = [t.encode() for t in texts]
    altered = [t.encode() for t in edited]
    chained = all(a is b for a, b in zip(texts[1:], following))
    own = fingerprints(plain + ([following[-1].encode()] if chained else [f.encode() for f in following]))
    after = own[1:] if chained else own[len(texts) :]
    own, new = own[: len(texts)], fingerprints(altered)
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in altered], "fingerprint": own, "edited_fingerprint": new,
        "near_edited": [likeness(a, b) for a, b in zip(own, new)], "near_next": [likeness(a, b) for a, b in zip(own, after)],
    }


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last quarter of code points replaced by the first as many of the next document's.

    Null texts are empty. Rows follow one another by doc_id (nulls first), then by a hash of the text; after the last
    comes the first, so a single row follows itself. Repeated rows are rows of their own. Other columns are
    ignored, and an empty table gives an empty result.

    Texts are dealt by ranges of doc_id and sorted once; each task streams over its range. Only the last row of a
    range, whose successor is in another task, is worked out in a second small step."""
    # Equal rows may be dealt to several ranges: which of them comes first makes no difference.
    rows = texts_only(docs).withColumns({"_h": F.xxhash64("text"), "_own": F.monotonically_increasing_id()})
    order = (F.col("doc_id").asc_nulls_first(), F.col("_h").asc(), F.col("_own").asc())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h", "_own")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, first, held_ids, held, size = TaskContext.get().partitionId(), True, [], [], 0

        def edge(kind: int, doc, text: str) -> dict:
            made = {"kind": [kind], "part": [part], "edge_id": pa.array([doc], pa.int64()), "edge": [text]}
            return made | {c.split()[0]: pa.nulls(1) for c in COLUMNS.split(", ")}

        def out() -> dict:
            made = _rows(held_ids[:-1], held[:-1], held[1:])
            n = len(held) - 1
            return {"kind": [0] * n, "part": [part] * n, "edge_id": pa.nulls(n), "edge": pa.nulls(n)} | made

        for batch in batches:
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = cell.as_py()
                if first:
                    yield edge(1, doc, text)
                    first = False
                held_ids.append(doc)
                held.append(text)
                size += len(text)
                if size > BLOCK_BYTES and len(held) > 1:
                    yield out()
                    held_ids, held, size = held_ids[-1:], held[-1:], len(text)
        if len(held) > 1:
            yield out()
        if held:
            yield edge(2, held_ids[-1], held[-1])

    made = stage(map_batches(rows, f"kind int, part int, edge_id long, edge string, {COLUMNS}", stream), "piecewise")
    # Two rows per range: the first text and the last.
    edges = made.filter("kind > 0").select("kind", "part", "edge_id", "edge")
    heads = edges.filter("kind = 1").select("part", F.col("edge").alias("head"))
    heads = heads.withColumn("of", F.lag("part").over(Window.orderBy("part")))
    heads = heads.withColumn("of", F.coalesce("of", F.max("part").over(Window.partitionBy())))
    last = edges.filter("kind = 2").join(heads.select(F.col("of").alias("part"), "head"), "part").select("edge_id", "edge", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, text, head in zip(*(batch.column(c).to_pylist() for c in ("edge_id", "edge", "head"))):
                yield _rows([doc], [text], [head])

    return made.filter("kind = 0").drop("kind", "part", "edge_id", "edge").unionByName(map_batches(last, COLUMNS, finish))

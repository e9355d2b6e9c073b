"""Packing by power-of-two decomposition.

A document's token count is cut into pieces by its binary digits: as many of the greatest length as fit, then one
piece for each set bit below. Every piece is a sequence by itself, so no sequence crosses documents and none is
padded; sequences of one length form a bucket, and a batch is drawn from one bucket."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, stage, texts_only

LENGTH = 2048
END = 1  # the id that closes a document
RANGE = 1 << 12  # pieces numbered in one group
LONG_RUN = 50_000
_long_run = re.compile(rf"\s{{{LONG_RUN}}}|[^\W\d_]{{{LONG_RUN}}}|[^\w\s]{{{LONG_RUN}}}|\d{{{LONG_RUN}}}")


def encoder(path: str):
    """A function from text to ids, the same ids as the tokenizers file gives. Texts that hold a special token's
    string, or a run of LONG_RUN characters or more of one class, go through tokenizers itself; the others through tiktoken over the
    same ranks (several times faster, but its matcher runs out of stack on a run of about a million)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def ids(text: str) -> list[int]:
        if any(s in text for s in special) or (len(text) >= LONG_RUN and _long_run.search(text)):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def cut(tokens: int, length: int = LENGTH) -> list[int]:
    """Piece lengths: whole sequences, then the set bits of the rest, longest first."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and (keep_ids) its ids as 4-byte little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids = encoder(path)
        for batch in batches:
            docs_, starts, lengths, crcs, totals, payload, held = [], [], [], [], [], [], 0

            def out() -> dict:
                made = {"doc_id": pa.array(docs_, pa.int64()), "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals}
                return made | ({"ids": pa.array(payload, pa.binary())} if keep_ids else {})

            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                coded = np.array([*ids(text.as_py()), END], "<u4").tobytes()
                n, at = len(coded) // 4, 0
                for size in cut(n, length):
                    piece = coded[4 * at : 4 * (at + size)]
                    docs_.append(doc)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
                    if keep_ids:
                        payload.append(piece)
                    at += size
                held += len(coded)
                if held > 1 << 22:
                    yield out()
                    docs_, starts, lengths, crcs, totals, payload, held = [], [], [], [], [], [], 0
            if docs_:
                yield out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return map_batches(texts_only(docs), schema, run)


def pack(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Per piece also sequence_id long and offset long (0: a piece is its sequence). ``length`` is a power of two.

    A null or empty text is the closing id alone; every row is packed, so repeated rows are packed repeatedly and
    a null doc_id is kept; other columns are ignored; an empty table gives an empty result. Sequences are
    numbered from 0 without gap, bucket after bucket, the shortest first.

    Numbers are given without one task seeing a whole bucket: pieces are dealt to ranges by a hash, ranges are
    counted, and a piece's number is its range's start plus its place in the range."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    # Pieces of equal rows would share a hash, and a range: a number of their own parts them.
    made = stage(pieces(docs, path, length, keep_ids).withColumn("_own", F.monotonically_increasing_id()), "pack-pieces")
    counts = made.groupBy("length").agg(F.count("*").alias("n"))
    ranges = F.ceil(F.col("n") / RANGE).cast("long")
    counts = stage(counts.withColumn("ranges", ranges), "pack-counts")
    u = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "_own")
    dealt = made.withColumn("_u", u).join(F.broadcast(counts.drop("n")), "length")
    dealt = dealt.withColumn("_range", F.pmod(F.col("_u"), F.col("ranges")))
    here = dealt.groupBy("length", "_range").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("length").orderBy("_range")) - F.col("_here")
    here = here.select("length", "_range", before.alias("_before"))
    # A bucket begins after all shorter ones; one row per power of two.
    base = counts.select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("_base"))
    here = stage(here.join(F.broadcast(base), "length"), "pack-ranges")
    order = Window.partitionBy("length", "_range").orderBy("_u", "_own")
    ranked = dealt.withColumn("_n", F.row_number().over(order) - 1).join(here, ["length", "_range"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    number = F.col("_base") + F.col("_before") + F.col("_n")
    return ranked.select(*columns, number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

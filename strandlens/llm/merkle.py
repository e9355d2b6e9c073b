"""Merkle manifests of a table by butterfly exchange.

Rows of a group are leaves in order, and every FANOUT neighbours have a parent. Leaves are dealt to aligned blocks of
FANOUT**LEVELS leaves, and a task hashes a block up to its root. From there on blocks are the partners of a butterfly:
in round r, up to FANOUT blocks whose numbers differ in digit r only (to the base FANOUT) swap the roots that they
hold, and each of them hashes the common parent for itself. So after the last round every block holds the group's root
and all siblings above it, and nothing has to be sent down again. The groups' roots are the leaves of the upper
tree, whose partners are the groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, stage

FANOUT = 16
LEVELS = 3  # of a block, which so has 4096 leaves at most
HEX = 64  # digits of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two rows give one text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(hashes: list[str], levels: int | None = None) -> list[list[str]]:
    """The nodes of each level above ``hashes``, these included: up to a single node, or just so many levels."""
    out = [hashes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def fold(node: str, at: int, siblings: list[str]) -> str:
    """The root that a node and its siblings give: an entry per level, the others of its run from left to right."""
    for others in siblings:
        place = at % FANOUT * HEX
        node = _digest(others[:place] + node + others[place:])
        at //= FANOUT
    return node


def exchange(nodes: DataFrame) -> DataFrame:
    """The butterfly. ``nodes``: tree, node (0 to n - 1), n and hash; returns tree, node, top (the tree's root) and above
    (per level the others of the run, joined).

    A partner that isn't there, as the last subtree of a tree may have fewer blocks, is stood in for by one of those
    that the subtree has, each for about as many as the others. A swap has FANOUT rows at most, whatever a tree's size;
    a round is one shuffle of a row per block."""
    state = nodes.withColumn("above", F.array().cast("array<string>"))
    most, span = nodes.agg(F.max("n")).first()[0] or 0, 1
    while span < most:
        width = F.lit(span).cast("long")
        state = state.withColumns({"_at": F.floor(F.col("node") / width), "_lane": F.col("node") % width, "_last": F.floor((F.col("n") - 1) / width)})
        members = F.col("n") - F.col("_last") * width
        ragged = (F.col("_at") == F.col("_last")) & (F.col("_last") % FANOUT > 0) & (members < width)
        lanes = F.when(ragged, F.sequence("_lane", width - 1, members)).otherwise(F.array("_lane"))
        sent = state.withColumn("_to", F.explode(lanes))
        swap = Window.partitionBy("tree", F.floor(F.col("_at") / FANOUT), "_to")
        sent = sent.withColumn("_heard", F.sort_array(F.collect_list(F.struct("_at", "hash")).over(swap)))
        sent = sent.filter("_to = _lane")
        joined = F.array_join(F.transform("_heard", lambda x: x["hash"]), "")
        others = F.array_join(F.transform(F.filter("_heard", lambda x: x["_at"] != F.col("_at")), lambda x: x["hash"]), "")
        unfinished = F.col("n") > width
        state = sent.select(
            "tree", "node", "n",
            F.when(unfinished, F.sha2(joined, 256)).otherwise(F.col("hash")).alias("hash"),
            F.when(unfinished, F.array_append("above", others)).otherwise(F.col("above")).alias("above"),
        )
        state = stage(state, "merkle-round")
        span *= FANOUT
    return state.select("tree", "node", F.col("hash").alias("top"), "above")


def _ordered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows in order over ranges, with ``_at``: the range's number and the place in it, in one integer."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")


def _range(at: str = "_at") -> Column:
    return F.shiftright(at, 33)


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups with ``rank``, their number by ``_group`` (null first, bytewise), and ``ranks``, how many there are."""
    placed = _ordered(groups, F.col("_group").asc_nulls_first())
    counts = placed.groupBy(_range().alias("_range")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # A row per range.
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    counts = counts.withColumn("ranks", F.sum("_n").over(Window.partitionBy()))
    held = placed.withColumn("_range", _range()).join(counts, "_range")
    return held.select("_group", "_rows", (F.col("_upto") + F.col("_at") - F.col("_first")).alias("rank"), "ranks")


def _leaves(rows: DataFrame, size: int) -> DataFrame:
    """rank, ranks, block (of ``size`` leaves), place (in the block), blocks (of the group), id, leaf and shown of each row.

    Rows are numbered by ranges, each group's offset per range from counts; a group of any size is spread over
    ranges, and equal rows too."""
    rows = stage(rows, "merkle-leaves").withColumn("_salt", F.monotonically_increasing_id())
    placed = _ordered(rows, F.col("_group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("_salt").asc())
    counts = placed.groupBy(_range().alias("_range"), "_group").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = stage(counts, "merkle-counts")
    ranks = _numbered(counts.groupBy("_group").agg(F.sum("_n").alias("_rows")))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")
    ranks = ranks.withColumnRenamed("_group", "_of")
    counts = counts.withColumn("_upto", upto).join(ranks, F.col("_group").eqNullSafe(F.col("_of")))
    counts = counts.select(F.col("_range").alias("_in"), "_of", "_first", "_upto", "_rows", "rank", "ranks")
    held = placed.join(counts, (_range() == F.col("_in")) & F.col("_group").eqNullSafe(F.col("_of")))
    index = F.col("_upto") + F.col("_at") - F.col("_first")
    return held.select(
        "rank", "ranks", F.floor(index / size).alias("block"), (index % size).alias("place"),
        F.ceil(F.col("_rows") / size).alias("blocks"), "id", "leaf", "shown",
    )


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("rank", "block").sortWithinPartitions("rank", "block", "place")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["rank"], row["block"]) != key:
                if held:
                    yield held
                key, held = (row["rank"], row["block"]), []
            held.append(row)
    if held:
        yield held


def _climbed(rows: list[dict], levels: int) -> list[list[str]]:
    return climb([r["leaf"] for r in rows], levels if rows[0]["blocks"] > 1 else None)


def _roots(leaves: DataFrame, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in _blocks(batches):
            first = rows[0]
            yield {k: [first[k]] for k in ("rank", "ranks", "block", "blocks")} | {"hash": [_climbed(rows, levels)[-1][0]]}

    return map_batches(_together(leaves), "rank long, ranks long, block long, blocks long, hash string", run)


def manifest(rows: DataFrame, keep_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified, and (keep_proofs) proof: per level, from
    the leaf up, the others of its run from left to right, joined; from the level of groups on, those of the group.

    ``rows``: _group (any orderable type), id, leaf, and shown: another leaf that is offered for verification, or null
    for the row's own. Leaves of a group ascend by id (null first), those with one id by leaf; repeated rows are
    leaves of their own; groups ascend, null first. A group of one row has that leaf as its root, and a table of one
    group that group's. An empty table gives an empty result. ``levels`` of the tree are worked out per
    block, which doesn't change the result."""
    size = FANOUT**levels
    leaves = stage(_leaves(rows, size), "merkle-placed")
    roots = stage(_roots(leaves, levels), "merkle-roots")
    own = stage(exchange(roots.select(F.col("rank").alias("tree"), F.col("block").alias("node"), F.col("blocks").alias("n"), "hash")), "merkle-own")
    subroots = own.filter("node = 0").select(F.col("tree").alias("node"), F.col("top").alias("hash"))
    sizes = roots.filter("block = 0").select(F.col("rank").alias("node"), F.col("ranks").alias("n"))
    upper = subroots.join(sizes, "node").withColumn("tree", F.lit(0).cast("long"))
    upper = exchange(upper).select(F.col("node").alias("tree"), F.col("top").alias("root"), F.col("above").alias("beyond"))
    state = own.join(upper, "tree").select(
        F.col("tree").alias("rank"), F.col("node").alias("block"), F.lit(-1).cast("long").alias("place"),
        F.col("top").alias("subroot"), "root", "above", "beyond",
    )
    mixed = leaves.drop("ranks").unionByName(state, allowMissingColumns=True)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * keep_proofs]
        for state, *rows in _blocks(batches):
            nodes = _climbed(rows, levels)
            # Per level, the joined runs; a node's siblings are its run without itself.
            runs = [["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in nodes[:-1]]
            block, rank, above, beyond = state["block"], state["rank"], state["above"], state["beyond"]
            made = []
            for r in rows:
                at = r["place"]
                proof = []
                for level in runs:
                    run_, place = level[at // FANOUT], at % FANOUT * HEX
                    proof.append(run_[:place] + run_[place + HEX :])
                    at //= FANOUT
                proof += above
                folded = fold(r["shown"] or r["leaf"], block * size + r["place"], proof)
                folded = fold(folded, rank, beyond)
                proof += beyond
                row = (r["id"], r["leaf"], state["subroot"], state["root"], _digest("".join(proof)), folded, folded == state["root"])
                made.append((*row, proof) if keep_proofs else row)
            yield dict(zip(names, map(list, zip(*made))))

    return map_batches(_together(mixed), schema + ", proof array<string>" * keep_proofs, run)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def of_documents(docs: DataFrame, every: int = 5, keep_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents grouped by source in order of doc_id, with every fifth of them (where ``every`` divides the
    CRC of its id) offered with its capital letters A to Z made small. A null id is offered as it is. See ``manifest``."""
    values = [F.col(c) for c in FIELDS]
    changed = leaf(*values[:-1], F.translate("text", UPPER, LOWER))
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, changed)
    rows = docs.select(F.col("source").alias("_group"), F.col("doc_id").alias("id"), leaf(*values).alias("leaf"), shown.alias("shown"))
    return manifest(rows, keep_proofs, levels).withColumnRenamed("id", "doc_id")

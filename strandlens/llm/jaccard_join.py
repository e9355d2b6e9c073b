"""N-gram Jaccard self-join by vertical partitioning.

All n-grams have one global order: rare ones first, by hash, then the frequent ones by falling rarity. Documents that
may be similar share one of their first n-grams in that order (prefix filter with lengths and places). Of a
candidate pair, each document's n-grams are cut along the n-gram hash into fragments; overlaps are counted fragment by
fragment and summed per pair, so no task needs a whole pair of long documents.

Only links that join classes matter: candidates are first chained, checked and merged, and then every
candidate pair that is still in different classes is checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import blocks, fresh, map_batches, stage, texts_only
from .graph import components
from .hashing import mix, signed, words

FRAGMENTS = 4  # a power of two
FREQUENT = 200_000  # frequent n-grams that the order ranks by count, at most
LOCAL = 3  # times that an n-gram occurs in a task's documents before it is counted
COUNTED = 1 << 21  # n-grams counted at once in a task
SALTS = 64
LAGS = 8  # neighbours that a set is paired with in a list
PAIR_BLOCK = 2048  # sets of one list that meet those of another block in one place
PARTNERS = 16
FILTER_WORDS = 1 << 17  # 64-bit words of the map of documents that are read again
_A = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-grams of words (A-Z lower-cased), as 64-bit hashes. A row of fewer words is one n-gram,
    one without words has none."""
    h, _, at = words(data, offsets)
    if len(h) >= width:
        n = len(h) - width + 1
        code = h[:n].copy()
        for k in range(1, width):
            code = code * _A + h[k : k + n]
        code = mix(code)
    else:
        code = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            v = np.sort(code[a : b - width + 1])
            out.append(v[np.concatenate(([True], v[1:] != v[:-1]))])
        elif b > a:
            short = np.full(1, np.uint64(b - a))
            for x in h[a:b]:
                short = short * _A + x
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(grams: np.ndarray) -> int:
    """A set's 64-bit key, as a signed number. Two of N different sets share one with a chance of about N^2 / 2^65."""
    with np.errstate(over="ignore"):
        k = int(np.add.reduce(mix(grams ^ _A))) if len(grams) else 0
    return k - (1 << 64) if k >> 63 else k


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the n-grams whose hash ends in b; at least two bits an n-gram. Two sets differ in at
    least as many n-grams as their sketches in bits."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length()) if len(grams) else 64
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _mini(grams: np.ndarray) -> np.ndarray:
    """The same with 256 bits, for all sets."""
    odd = np.bincount((grams & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _listed(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows of kind 0: doc_id, k (the set's key), n and sketch; of kind 1: k (an n-gram) and n (a task's count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counts() -> dict:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            grams, times = grams[times >= LOCAL], times[times >= LOCAL]
            n = len(grams)
            return {"kind": [1] * n, "doc_id": pa.nulls(n), "k": signed(grams), "n": times, "sketch": pa.nulls(n), "mini": pa.nulls(n)}

        for batch, i, j, data, offsets in blocks(batches):
            sets = shingles(data, offsets, width)
            keys = [_key(s) for s in sets]
            yield {"kind": [0] * (j - i), "doc_id": batch.column("doc_id")[i:j], "k": keys, "n": [len(s) for s in sets], "sketch": _listed([_sketch(s) for s in sets]), "mini": _listed([_mini(s) for s in sets])}
            for s, k in zip(sets, keys):
                if k not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size > COUNTED:
                yield counts()
                held, size = [], 0
        if held:
            yield counts()

    return map_batches(docs, "kind int, doc_id long, k long, n long, sketch array<long>, mini array<long>", run)


def _prefixes(docs: DataFrame, width: int, percent: int, frequent: list[int]) -> DataFrame:
    """k, n, first (the n-grams that a similar set may share first, in the global order) and rare: how many of those are not
    frequent. A set that several documents of a task have comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        often = np.array(frequent, np.int64).view(np.uint64)  # most frequent first
        rank = np.argsort(often)
        ordered = often[rank]
        low = np.uint64((1 << 22) - 1)
        maybe = np.zeros(1 << 22, bool)
        maybe[(often & low).astype(np.int64)] = True
        seen: set[int] = set()
        for _, _, _, data, offsets in blocks(batches):
            keys, sizes, firsts, rare = [], [], [], []
            for s in shingles(data, offsets, width):
                k = _key(s)
                if not len(s) or k in seen:
                    continue
                seen.add(k)
                size = len(s) - -(-percent * len(s) // 100) + 1
                hit = np.flatnonzero(maybe[(s & low).astype(np.int64)])
                place = np.minimum(np.searchsorted(ordered, s[hit]), max(len(ordered) - 1, 0))
                real = ordered[place] == s[hit] if len(hit) else np.zeros(0, bool)
                hit, place = hit[real], place[real]
                mask = np.ones(len(s), bool)
                mask[hit] = False
                light = s[mask][:size]
                heavy = s[hit[np.argsort(-rank[place])]][: size - len(light)]
                keys.append(k)
                sizes.append(len(s))
                firsts.append(signed(np.concatenate([light, heavy])))
                rare.append(len(light))
            yield {"k": keys, "n": sizes, "first": _listed(firsts), "rare": rare}

    return map_batches(docs, "k long, n long, first array<long>, rare int", run)


def _bits(wanted: DataFrame) -> np.ndarray:
    """A bit map of FILTER_WORDS x 64 bits, set where a row's number (column h) falls: a fixed size, whatever the rows."""
    at = wanted.select(F.pmod(F.col("h"), F.lit(FILTER_WORDS * 64)).alias("at"))
    words_ = at.select(F.expr("cast(at div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in words_.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out


def _fragments(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """k, fragment, grams of the sets in ``nodes`` (k, doc_id: one document that has it): n-grams cut along the hash. Which
    documents are needed reaches the tasks as a bit map, so texts are not shuffled; a few more rows than needed come,
    and a row may come twice."""
    cuts = np.array([i * ((1 << 64) // FRAGMENTS) for i in range(1, FRAGMENTS)], np.uint64)
    bits = _bits(nodes.select(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("k")).alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, i, j, data, offsets in blocks(batches):
            keys, parts, grams = [], [], []
            for doc, s in zip(batch.column("doc_id")[i:j].to_pylist(), shingles(data, offsets, width)):
                k = _key(s)
                h = ((doc or 0) ^ k) % (FILTER_WORDS * 64)
                if not int(bits[h // 64]) >> (h % 64) & 1:
                    continue
                at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
                for f, (a, b) in enumerate(zip(at, at[1:])):
                    if b > a:
                        keys.append(k)
                        parts.append(f)
                        grams.append(signed(s[a:b]))
            yield {"k": keys, "fragment": parts, "grams": _listed(grams)}

    return map_batches(docs, "k long, fragment int, grams array<long>", run)


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb) those whose similarity is at least ``percent`` (u, v): overlaps per fragment, summed."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    named = keys.join(nodes.select("k", "doc_id"), "k")
    pieces = stage(_fragments(docs, named, width), "grams-fragments")
    cut = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])))
    left = pieces.select(F.col("k").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = pieces.select(F.col("k").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max(F.size(F.array_intersect("ga", "gb"))).alias("overlap"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    linked = total.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))
    return stage(linked.select(F.col("a").alias("u"), F.col("b").alias("v")), "grams-links")


def _need(percent: int):
    return F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))


def _compatible(percent: int):
    """A pair's shared n-gram is early enough in both, and their sizes are near enough, to be linked."""
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return near & (F.col("pa") <= F.col("na") - _need(percent)) & (F.col("pb") <= F.col("nb") - _need(percent))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches differ in no more bits than linked sets may differ in n-grams."""
    sketches = nodes.select("k", "sketch")
    both = pairs.join(sketches.withColumnsRenamed({"k": "a", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"k": "b", "sketch": "sb"}), "b")
    size = F.least(F.size("sa"), F.size("sb"))

    def folded(c: str):
        halves = F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > size, halves).otherwise(F.col(c))

    differ = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return both.filter(differ <= F.col("na") + F.col("nb") - 2 * _need(percent)).select("a", "b", "na", "nb")


def _pairs(rows: DataFrame, one, two, percent: int) -> DataFrame:
    made = rows.select(*[one(c).alias(f"{n}a") for c, n in (("k", "k"), ("n", "n"), ("place", "p"))], *[two(c).alias(f"{n}b") for c, n in (("k", "k"), ("n", "n"), ("place", "p"))])
    made = made.filter(_compatible(percent) & (F.col("ka") != F.col("kb")))
    first = F.col("ka") < F.col("kb")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return made.select(pick("ka", "kb").alias("a"), pick("kb", "ka").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()


def _chained(member: DataFrame, percent: int) -> DataFrame:
    """Pairs of neighbours in each n-gram's list: sets of near sizes side by side, otherwise in an
    order that differs by n-gram. Long lists are dealt over parts. At most PARTNERS pairs of a set are kept, which
    may be any as the pairs left over are checked at the end."""
    mixed = F.xxhash64("k", "gram")
    part = F.pmod(mixed, F.ceil(F.col("size") / 4096).cast("long"))
    here = Window.partitionBy("gram", "part").orderBy(F.floor(F.log("n") / 0.05), mixed)
    near = [F.lag(F.struct("k", "n", "place"), i).over(here) for i in range(1, LAGS + 1)]
    rows = member.withColumn("part", part).withColumn("before", F.array(*near))
    rows = rows.withColumn("before", F.explode(F.filter("before", lambda x: x.isNotNull())))
    pairs = _pairs(rows, lambda c: F.col(f"before.{c}"), F.col, percent)
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b")))
    return pairs.withColumn("_n", first).filter(F.col("_n") <= PARTNERS).drop("_n")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links of ``percent`` or more).

    Null and empty texts have no n-grams and are linked with nothing. Rows are documents of their own, also such
    as repeat a doc_id or have none; those with equal sets are linked, and cost no more than one: the work is done on
    distinct sets, so a group of copies of any size is one node. An empty table gives an empty result; other columns are
    ignored. N-grams and sets are compared by 64-bit hashes."""
    texts = texts_only(docs)
    made = stage(_sets(texts, width), "grams-sets")
    each = made.filter("kind = 0").select("doc_id", "k", "n")
    nodes = made.filter("kind = 0 and n > 0").groupBy("k").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini"))
    nodes = stage(nodes, "grams-nodes")
    often = made.filter("kind = 1").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(FREQUENT)
    frequent = [r["k"] for r in often.select("k").collect()]  # at most FREQUENT numbers

    first = _prefixes(texts, width, percent, frequent)
    # Frequent n-grams are shared anyway; they are dealt over SALTS.
    salt = F.when(F.col("place") >= F.col("rare"), F.pmod(F.xxhash64("k"), F.lit(SALTS)) + 1).otherwise(0)
    posts = first.select("k", "n", "rare", F.posexplode("first").alias("place", "gram"))
    # One number for what belongs to a set, to keep the largest shuffle small: n, place, salt.
    posts = posts.withColumn("place", F.when(F.col("place") < 1 << 24, F.col("place")).otherwise(F.raise_error(F.lit("a prefix of more than 16 million n-grams"))))
    info = F.shiftleft("n", 31) + F.shiftleft(F.col("place").cast("long"), 7) + salt
    posts = posts.select("gram", "k", info.alias("info"), salt.cast("int").alias("salt"))
    here = Window.partitionBy("gram", "salt")
    posts = posts.withColumn("others", (F.min("k").over(here) != F.max("k").over(here)) | (F.col("salt") > 0)).filter("others")
    posts = posts.select("gram", "k", "salt", F.shiftright("info", 31).alias("n"), F.shiftright("info", 7).bitwiseAND(F.lit((1 << 24) - 1)).alias("place"))
    posts = stage(posts.distinct(), "grams-shared")

    sizes = posts.groupBy("gram").agg(F.count("*").alias("size"))
    member = stage(posts.drop("salt").join(sizes, "gram"), "grams-members")
    tried = stage(_chained(member, percent), "grams-chained")
    merged = components(_links(stage(_possible(tried, nodes, percent), "grams-possible"), texts, nodes, width, percent))
    member = member.join(merged.withColumnRenamed("node", "k"), "k", "left")
    member = stage(member.withColumn("component", F.coalesce("component", "k")), "grams-members")

    # What the chains did not bring together: all candidates of different classes that weren't tried.
    several = member.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("gram")
    open_ = member.join(several, "gram", "left_semi").join(nodes.select("k", "mini"), "k")
    # Long lists are cut into blocks and joined block by block, so that a hot n-gram's pairs are spread over tasks.
    many = F.ceil(F.col("size") / PAIR_BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64(F.lit("block"), "k"), many).cast("int"), F.explode(F.sequence(F.lit(0), many - 1))
    sides = {"l": (own, every), "r": (every, own)}
    columns = ("k", "n", "place", "component", "mini")
    left, right = (
        open_.select("gram", *[F.col(c).alias(f"{side}_{c}") for c in columns], a.alias("l_block"), b.alias("r_block")) for side, (a, b) in sides.items()
    )
    need = F.ceil(percent * (F.col("l_n") + F.col("r_n")) / (100 + percent))
    differ = sum((F.bit_count(F.get("l_mini", F.lit(i)).bitwiseXOR(F.get("r_mini", F.lit(i)))) for i in range(4)), F.lit(0))
    # All that can be told of a pair without its n-grams is told in the join.
    told = (F.col("l_k") < F.col("r_k")) & (F.col("l_component") != F.col("r_component"))
    told = told & (100 * F.least("l_n", "r_n") >= percent * F.greatest("l_n", "r_n")) & (differ <= F.col("l_n") + F.col("r_n") - 2 * need)
    told = told & (F.col("l_place") <= F.col("l_n") - need) & (F.col("r_place") <= F.col("r_n") - need)
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("gram", "l_block", "r_block")})
    here = (F.col("gram") == F.col("_gram")) & (F.col("l_block") == F.col("_l_block")) & (F.col("r_block") == F.col("_r_block"))
    crossed = left.join(right, here & told)
    rest = _pairs(crossed, lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"), percent).join(tried, ["a", "b"], "left_anti")
    rest = stage(_possible(rest, nodes, percent), "grams-rest")
    if not rest.isEmpty():
        more = _links(rest, texts, nodes, width, percent)
        merged = components(more.unionByName(merged.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    root = nodes.select("k", "doc_id").join(merged.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("component", "k"))
    root = stage(root.select("k", "doc_id", "root"), "grams-roots")
    smallest = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = root.join(smallest, "root").select("k", "component_id")
    out = each.join(named, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their class (see ``classes``), all columns kept. Of rows that are equal in
    doc_id and text one stays; texts without words are classes of their own."""
    (name,) = fresh(docs, "key")
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    keep = classes(docs, width, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = docs.withColumn(name, key).join(keep.select(key.alias(name)).distinct(), name, "left_semi").dropDuplicates([name, "text"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Recovering the roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines, some with a speaker marker, whose speakers aren't known. Hidden states are a role
and whether the line begins a turn; observed are the marker's kind and a few features of the line. Viterbi's best path
is worked out in max-plus algebra: a stretch of lines is a small matrix, matrices of neighbouring stretches combine, so
a transcript of any length is split over tasks and only its stretches' matrices meet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches, stage

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in range(3) for b in (1, 0)]  # (role, begins a turn)
S = len(STATES)
SAMPLE = 50_000  # labelled lines that are learned from, at most
CHUNK = 64  # orders in a run that is learned from
STRETCH = 512  # lines in a stretch; also how many stretches are combined at once
# Fixed marker spellings, by the role that they usually stand for.
MARKERS = {"system": "system sys instructions context", "user": "user human customer q question me you", "assistant": "assistant ai bot agent a answer model"}
MARKER = re.compile(r"^\s*(?:[#>*\-\[<(|]+\s*)*([A-Za-z]{1,12})\s*[\])>|*]*\s*(?:[:\-–—>])\s*")
_KIND = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r].split()}
KINDS = 5  # no marker, one of each role, an unknown name
SHAPES = 12  # first line, length class, ends like a question


def marker_of(line: str) -> tuple[int, int]:
    """Kind of the line's marker, and where the text begins. Unknown words before a colon count as a kind of their own."""
    m = MARKER.match(line)
    if not m:
        return 0, 0
    kind = _KIND.get(m[1].lower())
    return (kind, m.end()) if kind else (4, 0)


def observe(line: str, first: bool) -> tuple[int, int]:
    kind, at = marker_of(line)
    size = len(line) - at
    return kind, (first * 2 + line.rstrip().endswith("?")) * 3 + (0 if size < 40 else 1 if size < 200 else 2)


def lines_of(texts: DataFrame, key: str, order: str, text: str = "text", *more: str) -> DataFrame:
    """Rows of lines: key, order, line_no, line. A null or empty text is one empty line, so no row is lost."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return texts.select(F.col(key).alias("key"), F.col(order).alias("order"), *more, F.posexplode(split).alias("line_no", "line"))


def train(lines: DataFrame, sample: int = SAMPLE) -> dict[str, list]:
    """Model by counts from lines with role and begins, in order within their key: about ``sample`` lines, in runs of
    CHUNK orders of a key that a hash selects. Unknown roles count as user."""
    total = lines.count()
    share = min(1.0, sample / max(total, 1))
    chunk = F.floor(F.coalesce(F.col("order"), F.lit(0)) / CHUNK)
    u = F.pmod(F.xxhash64(F.lit("train"), "key", chunk), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = lines.filter(u < share).withColumn("chunk", chunk)
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    state = role * 2 + F.when(F.col("begins"), 0).otherwise(1)
    at = Window.partitionBy("key", "chunk").orderBy("order", "line_no", "line")
    before = F.coalesce(F.lag("state").over(at), F.when(F.col("chunk") > 0, -1))
    rows = rows.withColumn("state", state).withColumn("before", before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            seen = [observe(t.as_py() or "", b is None) for t, b in zip(batch.column("line"), batch.column("before").to_pylist())]
            yield {"before": batch.column("before"), "state": batch.column("state"), "kind": [s[0] for s in seen], "shape": [s[1] for s in seen]}

    counts = map_batches(rows.select("line", "before", "state"), "before int, state int, kind int, shape int", run)
    start, move = np.full(S, 0.5), np.full((S, S), 0.5)
    kind, shape = np.full((S, KINDS), 0.5), np.full((S, SHAPES), 0.5)
    # At most (S + 1) x S x KINDS x SHAPES rows.
    for r in counts.groupBy("before", "state", "kind", "shape").count().collect():
        n, s = r["count"], r["state"]
        kind[s, r["kind"]] += n
        shape[s, r["shape"]] += n
        if r["before"] is None:
            start[s] += n
        elif r["before"] >= 0:
            move[r["before"], s] += n
    for i, (role_i, _) in enumerate(STATES):
        for j, (role_j, begins) in enumerate(STATES):
            if not begins and role_i != role_j:
                move[i, j] = 1e-12  # a line that goes on has its turn's role
    start[[j for j, (_, b) in enumerate(STATES) if not b]] = 1e-12
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).tolist()
    return {"start": log(start), "move": log(move), "kind": log(kind), "shape": log(shape)}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _steps(lines: list[str], first: bool, model: dict) -> np.ndarray:
    """Per line the matrix from the state before it to its state; before the first line every state is the start."""
    move, start = np.array(model["move"]), np.array(model["start"])
    kind, shape = np.array(model["kind"]), np.array(model["shape"])
    seen = np.array([observe(t, first and i == 0) for i, t in enumerate(lines)]).reshape(-1, 2)
    emit = kind[:, seen[:, 0]].T + shape[:, seen[:, 1]].T
    out = move[None, :, :] + emit[:, None, :]
    if first and len(lines):
        out[0] = start[None, :] + emit[0][None, :]
    return out


def _walk(steps: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after each line given scores before the first, and each line's best predecessor."""
    scores, back = np.empty((len(steps), S)), np.empty((len(steps), S), np.int64)
    for t, m in enumerate(steps):
        all_ = enter[:, None] + m
        back[t] = all_.argmax(axis=0)
        enter = scores[t] = all_.max(axis=0)
    return scores, back


def recover(lines: DataFrame, model: dict) -> DataFrame:
    """``lines`` (key, order, line_no, line) with role, begins and turn_text: the line without its marker.

    Lines follow one another by order, line_no and text; a null key is a transcript of its own, null lines are empty,
    repeated rows are lines of their own. An empty table gives an empty result; other columns are dropped.

    The positions of lines are found by counting per stretch of ``order``; the best path by three passes: matrices of stretches,
    scores entering each stretch and the state leaving it (stretches only, combined STRETCH at a time), and the
    path inside each stretch."""
    rows = lines.select("key", "order", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    rows = stage(_numbered(rows), "chat-lines")
    spec = "key long, stretch long"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
        """Streams of rows sorted by key and stretch, cut at changes; a stretch has STRETCH lines at most."""
        at, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("stretch").to_pylist()))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if held and at != keys[i]:
                    yield at, held
                    held = []
                at = keys[i]
                held.append(batch.slice(i, j - i))
                i = j
        if held:
            yield at, held

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out = []
        for (key, stretch), parts in gather(batches):
            text = [t for p in parts for t in p.column("line").to_pylist()]
            product = None
            for m in _steps(text, stretch == 0, model):
                product = m if product is None else _times(product, m)
            out.append((key, stretch, product.ravel().tolist()))
            if len(out) >= 1000:
                yield {"key": pa.array([o[0] for o in out], pa.int64()), "stretch": [o[1] for o in out], "matrix": [o[2] for o in out]}
                out = []
        if out:
            yield {"key": pa.array([o[0] for o in out], pa.int64()), "stretch": [o[1] for o in out], "matrix": [o[2] for o in out]}

    dealt = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "n")
    products = stage(map_batches(dealt.select("key", "stretch", "line"), f"{spec}, matrix array<double>", matrices), "chat-matrices")
    bounds = _bounds(products)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (_, stretch), parts in gather(batches):
            table = pa.Table.from_batches(parts)
            text = table.column("line").to_pylist()
            enter = np.array(table.column("enter")[0].as_py())
            state = table.column("leave")[0].as_py()
            scores, back = _walk(_steps(text, stretch == 0, model), enter)
            path = []
            for t in range(len(text) - 1, -1, -1):
                path.append(state)
                state = int(back[t, state])
            path.reverse()
            yield {
                "key": table.column("key").combine_chunks(), "order": table.column("order").combine_chunks(), "line_no": table.column("line_no").combine_chunks(),
                "role": [ROLES[STATES[s][0]] for s in path], "begins": [bool(STATES[s][1]) for s in path],
                "turn_text": [t[marker_of(t)[1] :] if STATES[s][1] else t for t, s in zip(text, path)],
            }

    joined = rows.join(bounds, (rows["key"].eqNullSafe(bounds["key"])) & (rows["stretch"] == bounds["stretch"])).drop(bounds["key"]).drop(bounds["stretch"])
    joined = joined.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "n")
    columns = joined.select("key", "stretch", "order", "line_no", "line", "enter", "leave")
    return map_batches(columns, "key long, order long, line_no int, role string, begins boolean, turn_text string", paths)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds n (place in the key, from 0) and stretch. Lines are first counted per (key, slot of order), slots being
    STRETCH orders wide, then numbered within slots: no task needs a whole key's lines."""
    slot = F.floor(F.coalesce(F.col("order"), F.lit(-1)) / STRETCH)
    rows = rows.withColumn("slot", slot)
    counts = rows.groupBy("key", "slot").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("key", "slot", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("key", "slot").orderBy("order", "line_no", "line")) - 1
    placed = rows.withColumn("inside", inside)
    same = placed["key"].eqNullSafe(counts["key"]) & (placed["slot"] == counts["slot"])
    placed = placed.join(counts, same).drop(counts["key"]).drop(counts["slot"])
    n = F.col("before") + F.col("inside")
    return placed.select("key", "order", "line_no", "line", n.alias("n"), F.floor(n / STRETCH).cast("long").alias("stretch"))


def _bounds(products: DataFrame) -> DataFrame:
    """Per (key, stretch): enter (scores of the states before it) and leave (its last line's state on the best path).

    Groups of STRETCH neighbouring matrices are multiplied until a key has one group; then scores go down the levels
    forwards, and last states backwards."""

    levels = [products.withColumnRenamed("stretch", "at")]
    top = products.agg(F.max("stretch")).first()[0] or 0
    while top >= STRETCH:
        up = levels[-1].withColumn("group", F.floor(F.col("at") / STRETCH)).repartition("key", "group").sortWithinPartitions("key", "group", "at")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            at, product = None, None
            for batch in batches:
                for key, group, flat in zip(*(batch.column(c).to_pylist() for c in ("key", "group", "matrix"))):
                    m = np.array(flat).reshape(S, S)
                    if at == (key, group):
                        product = _times(product, m)
                        continue
                    if at is not None:
                        yield {"key": pa.array([at[0]], pa.int64()), "at": [at[1]], "matrix": [product.ravel().tolist()]}
                    at, product = (key, group), m
            if at is not None:
                yield {"key": pa.array([at[0]], pa.int64()), "at": [at[1]], "matrix": [product.ravel().tolist()]}

        levels.append(stage(map_batches(up.select("key", "group", "matrix"), "key long, at long, matrix array<double>", multiply), "chat-level"))
        top //= STRETCH

    # The root: one group per key, entered with even scores; it may end in any state.
    given = None
    for level in reversed(levels):
        rows = level.withColumn("group", F.floor(F.col("at") / STRETCH).cast("long"))
        if given is None:
            rows = rows.withColumn("g_enter", F.array(*[F.lit(0.0)] * S)).withColumn("g_leave", F.lit(-1))
        else:
            up = given.select(F.col("key").alias("g_key"), F.col("at").alias("g_at"), F.col("enter").alias("g_enter"), F.col("leave").alias("g_leave"))
            rows = rows.join(up, F.col("key").eqNullSafe(F.col("g_key")) & (F.col("group") == F.col("g_at"))).drop("g_key", "g_at")
        rows = rows.repartition("key", "group").sortWithinPartitions("key", "group", "at")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            at, held = None, []

            def out() -> dict:
                enter, enters = np.array(held[0][2]), []
                for _, flat, _, _ in held:
                    enters.append(enter)
                    enter = (enter[:, None] + np.array(flat).reshape(S, S)).max(axis=0)
                leave = held[0][3] if held[0][3] >= 0 else int(enter.argmax())
                leaves = []
                for (_, flat, _, _), entered in zip(reversed(held), reversed(enters)):
                    leaves.append(leave)
                    leave = int((entered + np.array(flat).reshape(S, S)[:, leave]).argmax())
                return {"key": pa.array([at[0]] * len(held), pa.int64()), "at": [h[0] for h in held], "enter": [e.tolist() for e in enters], "leave": leaves[::-1]}

            for batch in batches:
                for key, group, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "group", "at", "matrix", "g_enter", "g_leave"))):
                    if held and at != (key, group):
                        yield out()
                        held = []
                    at = (key, group)
                    held.append(rest)
            if held:
                yield out()

        given = stage(map_batches(rows.select("key", "group", "at", "matrix", "g_enter", "g_leave"), "key long, at long, enter array<double>, leave int", spread), "chat-bounds")
    return given.withColumnRenamed("at", "stretch")


def render(recovered: DataFrame) -> DataFrame:
    """One canonical turn per run of lines: key, order, line_no (of its first line), role, rendered. The first line of an
    ``order`` and every line that begins a turn opens a row, so a row never grows beyond one text of the input."""
    opens = F.col("begins") | (F.col("line_no") == 0)
    within = Window.partitionBy("key", "order").orderBy("line_no")
    rows = recovered.withColumn("turn", F.sum(F.when(opens, 1).otherwise(0)).over(within))
    turns = rows.groupBy("key", "order", "turn").agg(
        F.min("line_no").alias("line_no"), F.min_by("role", "line_no").alias("role"), F.min_by("begins", "line_no").alias("begins"),
        F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "turn_text"))), lambda x: x["turn_text"])).alias("body"),
    )
    open_ = F.when(F.col("begins"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    return turns.select("key", "order", "line_no", "role", "begins", F.concat(open_, F.col("body"), F.lit("\n")).alias("rendered"))

"""Toxicity by a weighted finite-state pattern grammar.

Three transducers are composed, and what they match is scored by clauses. The lexical one maps words, or their beginnings, to
classes with weights: insults are learned from labelled rows, and so are targets, beside small fixed lists of the closed
classes. The scope one marks what stands behind a negation or a reporting verb of its clause. The pattern one reads a clause to its
end and matches an insult where it is said of a target within reach, on either side, or where its place makes it an
address: among the first or last words of the clause. A threat needs a target. An insult that no pattern takes counts for nothing.
The heaviest path through the composed machine says what is matched; sums are by kind of match, and a logistic model
fitted on labelled rows turns them into a score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, stage, texts_only
from .fst import Arc, Runner, Transducer, compose

SAMPLE = 20_000  # labelled rows that are learned from, at most
ENTRIES = 5_000  # entries of each learned lexicon, at most
EVIDENCE = 25.0  # least likelihood ratio statistic of an entry
STEMS = (4, 5, 6)  # lengths of word beginnings that may be entries
THRESHOLD = 0.3
REACH = 6  # words between a target and what is said of it
EDGE = 4  # first and last words of a clause that may be an address

# Classes of words.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = "other insult threat target negation report end".split()
# Fixed word lists of the closed classes, in the four languages of the corpus.
WORDS = {
    THREAT: "kill hurt destroy beat die burn töten schlagen sterben tuer frapper mourir matar golpear morir",
    TARGET: "you your yourself he she they them this these those people du dich ihr euch tu toi vous ils elles tú usted ustedes ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says called calls wrote writes quoted claimed sagte nannte schrieb dit appelé écrit dijo llamó escribió",
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n|]+")
KINDS = ("addressed", "edge", "negated", "reported", "threat")
# How a match of each kind weighs against the others when the best path is sought.
PREFERENCE = {"addressed": 1.0, "edge": 0.75, "negated": 0.5, "reported": 0.5, "threat": 1.0}


def scopes() -> Transducer:
    """Reads classes, writes them with their scope: plain, negated or reported, the latter to the clause's end."""
    arcs = {}
    for scope in ("plain", "negated", "reported"):
        same = [Arc(OTHER, OTHER, 0.0, scope), Arc(TARGET, TARGET, 0.0, scope), Arc(END, END, 0.0, "plain")]
        marked = [Arc(c, f"{c} {scope}", 0.0, scope) for c in (INSULT, THREAT)]
        turned = [Arc(NEGATION, OTHER, 0.0, "negated" if scope == "plain" else scope), Arc(REPORT, OTHER, 0.0, "reported")]
        arcs[scope] = tuple(same + marked + turned)
    return Transducer("plain", frozenset(arcs), arcs)


def patterns(reach: int = REACH, edge: int = EDGE) -> Transducer:
    """Reads a clause of scoped classes, writes the kind of match of each word that is matched.

    States: ("at", k, r), k words into the clause (edge: further in) and r words behind the last target (reach: none near);
    ("wait", r), an insult or threat was taken that a target must follow within r more words; ("close", c), one was taken that
    the clause's end must follow within c more words."""
    arcs: dict = {}
    kind = {"plain": "addressed", "negated": "negated", "reported": "reported"}

    def take(symbol: str, to: tuple, at_edge: bool) -> Arc:
        what, scope = symbol.split()
        made = "threat" if what == THREAT and scope == "plain" else "edge" if at_edge and scope == "plain" else kind[scope]
        return Arc(symbol, made, PREFERENCE[made], to)

    insults = [f"{INSULT} {s}" for s in kind]
    said = [*insults, *[f"{THREAT} {s}" for s in kind]]
    for k in range(edge + 1):
        for r in range(reach + 1):
            on = ("at", min(k + 1, edge), min(r + 1, reach))
            out = [Arc(OTHER, "", 0.0, on), Arc(TARGET, "", 0.0, ("at", min(k + 1, edge), 0)), Arc(END, "", 0.0, "done")]
            for symbol in said:
                out.append(Arc(symbol, "", 0.0, on))
                out.append(take(symbol, ("wait", reach - 1), False))
                if r < reach:
                    out.append(take(symbol, on, False))
                if symbol in insults:
                    if k < edge:
                        out.append(take(symbol, on, True))
                    out.append(take(symbol, ("close", edge - 1), True))
            arcs["at", k, r] = tuple(out)
    for r in range(reach):
        out = [Arc(TARGET, "", 0.0, ("at", edge, 0))]
        if r:
            out += [Arc(OTHER, "", 0.0, ("wait", r - 1)), *[take(s, ("wait", r - 1), False) for s in said]]
        arcs["wait", r] = tuple(out)
    for c in range(edge):
        out = [Arc(END, "", 0.0, "done")]
        if c:
            out += [Arc(x, "", 0.0, ("close", c - 1)) for x in (OTHER, TARGET)] + [take(s, ("close", c - 1), True) for s in insults]
        arcs["close", c] = tuple(out)
    arcs["done"] = ()
    return Transducer(("at", 0, reach), frozenset({"done"}), arcs)


def _features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def _near(text: str, insults: dict[str, float]) -> tuple[list[str], list[str]]:
    """The words within reach of an insult of their clause, and the others."""
    near, far, clause = [], [], []
    for token in [*TOKEN.findall(text.lower()), "."]:
        if token[0].isalpha():
            clause.append(token)
            continue
        at = [i for i, w in enumerate(clause) if any(f in insults for f in _features(w))]
        close = {j for i in at for j in range(max(0, i - REACH), i + REACH + 1)} - set(at)
        for j, w in enumerate(clause):
            (near if j in close else far).append(w)
        clause = []
    return near, far


def _count(rows: DataFrame, insults: dict[str, float] | None = None) -> DataFrame:
    """Per word or beginning: in how many toxic and other texts it occurs; with ``insults`` per word, how often it stands near one
    in toxic texts, and elsewhere in them. Counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> dict:
            keys = sums[0].keys() | sums[1].keys()
            keys = sorted(keys)
            return {"entry": keys, "toxic": [sums[1][k] for k in keys], "clean": [sums[0][k] for k in keys]}

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                if insults is None:
                    found = {f for w in {m for m in TOKEN.findall(text.as_py().lower()) if m[0].isalpha()} for f in _features(w)}
                    sums[toxic].update(found)
                elif toxic:
                    near, far = _near(text.as_py(), insults)
                    sums[1].update(near)
                    sums[0].update(far)
                if len(sums[0]) + len(sums[1]) > 500_000:
                    yield out()
                    sums = (Counter(), Counter())
        if sums[0] or sums[1]:
            yield out()

    made = map_batches(rows, "entry string, toxic long, clean long", run)
    return made.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _likelihood(k, n, p):
    return k * F.log(p) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def _told(counted: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the entries that tell one kind best: ENTRIES at most, by the likelihood ratio statistic."""
    if not toxic or not clean:
        return {}
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p, q, r = (a + 1e-9) / toxic, (b + 1e-9) / clean, (a + b) / (toxic + clean)
    t, c = F.lit(float(toxic)), F.lit(float(clean))
    ratio = 2 * (_likelihood(a, t, F.least(p, F.lit(1.0))) + _likelihood(b, c, F.least(q, F.lit(1.0))) - _likelihood(a, t, r) - _likelihood(b, c, r))
    odds = F.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
    told = counted.filter(p > q).withColumn("ratio", ratio).withColumn("odds", odds)
    told = told.filter((F.col("ratio") >= EVIDENCE) & (F.col("odds") >= 2)).orderBy(F.desc("ratio"), "entry").limit(ENTRIES)
    return {r["entry"]: r["odds"] for r in told.select("entry", "odds").collect()}


def lexicon(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Insults: entries that tell toxic texts from others, with their log odds."""
    return _told(_count(rows), toxic, clean)


def learned_targets(rows: DataFrame, insults: dict[str, float]) -> list[str]:
    """Words that toxic texts hold near insults rather than elsewhere."""
    counted = stage(_count(rows, insults), "toxic-targets")
    total = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    return sorted(w for w in _told(counted, total["toxic"] or 0, total["clean"] or 0) if w not in insults)


class _Classes(dict):
    """The lexical transducer: a token's class and weight, worked out once per token. ``hot``: tokens that may be matched."""

    def __init__(self, entries: dict[str, float], targets: list[str]):
        super().__init__()
        self.entries, self.hot, self.closed = entries, set(), {w: c for c, ws in WORDS.items() for w in ws.split()}
        self.closed |= {w: TARGET for w in targets if w not in self.closed}

    def learn(self, tokens: set[str]) -> None:
        if len(self) > 200_000:
            self.clear()
        for token in [t for t in tokens if t not in self]:
            if not token[0].isalpha():
                self[token] = END, 0.0
                continue
            weight = max((self.entries[f] for f in _features(token) if f in self.entries), default=0.0)
            self[token] = (INSULT, weight) if weight else (self.closed.get(token, OTHER), 1.0)
            if self[token][0] in (INSULT, THREAT):
                self.hot.add(token)


def matcher(entries: dict[str, float], targets: list[str] = ()):
    """A function from a text to its sums of matches by KINDS. Only clauses with an insult or a threat are walked."""
    classes, machine = _Classes(entries, list(targets)), Runner(compose(scopes(), patterns()))
    place = {kind: i for i, kind in enumerate(KINDS)}

    def sums(text: str) -> list[float]:
        total = [0.0] * len(KINDS)
        tokens = TOKEN.findall(text.lower())
        different = set(tokens)
        classes.learn(different)
        if classes.hot.isdisjoint(different):
            return total
        done = 0
        for i in [i for i, t in enumerate(tokens) if t in classes.hot]:
            if i < done:
                continue
            start = i
            while start > done and tokens[start - 1][0].isalpha():
                start -= 1
            done = i
            while done < len(tokens) and tokens[done][0].isalpha():
                done += 1
            symbols, scale = zip(*[classes[t] for t in tokens[start:done]], (END, 0.0))
            _, written = machine.best(symbols, scale)
            for kind, weight in zip(written, scale):
                if kind:
                    total[place[kind]] += weight
        return total

    return sums


def _inputs(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    logs = np.log1p(sums)
    matched = sums[:, [0, 1, 4]].sum(axis=1)
    return np.column_stack([np.ones(len(sums)), logs, np.log1p(matched), 10 * matched / (words + 50.0)])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


Model = tuple[dict[str, float], list[str], list[float]]  # insults, targets, weights of the logistic model


def _sums(rows: DataFrame, entries: dict[str, float], targets: list[str], keep: str, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        match = matcher(entries, targets)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            found = [match(t) for t in texts]
            yield {keep: batch.column(keep), "sums": pa.array(found, pa.list_(pa.float64())), "words": [t.count(" ") + 1 for t in texts]}

    return map_batches(rows, f"{schema}, sums array<double>, words long", run)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Insults, targets and weights from at most ``sample`` labelled rows that are not held out: the first by a hash of their
    id. Three quarters of them (by another hash) give the lexicons, the rest the weights. Rows without an id or with a label other
    than 0 and 1 don't count; several labels of one document count as toxic if one is. With one class only, the lexicons are empty."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(sample)
    # ``sample`` rows of two numbers bound what is broadcast.
    rows = stage(texts_only(docs).join(F.broadcast(known), "doc_id"), "toxic-sample")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)) > 0
    lexical = rows.filter(part)
    n = {r["toxic"]: r["n"] for r in lexical.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    entries = lexicon(lexical, n.get(1, 0), n.get(0, 0))
    targets = learned_targets(lexical, entries) if entries else []
    fitted = _sums(rows.filter(~part), entries, targets, "toxic", "toxic int").collect()
    if not fitted:
        return entries, targets, [-4.0] + [0.0] * (len(KINDS) + 2)
    x = _inputs(np.array([r["sums"] for r in fitted]), np.array([r["words"] for r in fitted], float))
    return entries, targets, _fit(x, np.array([r["toxic"] for r in fitted], float)).tolist()


def _scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    entries, targets, weights = model
    match, w = matcher(entries, targets), np.array(weights)

    def scores(texts: list[str]) -> np.ndarray:
        x = _inputs(np.array([match(t) for t in texts]), np.array([t.count(" ") + 1 for t in texts], float))
        return 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted. A null or empty text matches nothing and has the base score; only
    the text is an input. Repeated rows are scored each; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scores = _scorer(model)
        for batch in batches:
            if len(batch):
                p = scores([t.as_py() for t in batch.column("text")])
                yield {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    return map_batches(texts_only(docs), "doc_id long, score double, predicted int", run)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below THRESHOLD, all columns kept; see ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.schema.get_field_index("text"))]
            if texts:
                yield batch.filter(pa.array(scores(texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

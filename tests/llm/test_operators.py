"""Each operator against a brute-force version, and on rows that are null, empty, long, tied or repeated."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlens.llm import catalog, chat_roles, graph, jaccard_join, mixing, packing, permutation_index, piecewise, repeats, sharding, toxicity, warc
from strandlens.llm.catalog import tokenizer_path, transcripts
from strandlens.llm.frames import combine, scratch_path
from strandlens.llm.fst import Runner, compose, paths

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names an operator uses itself.
EXTRA = "doc_id long, text string, source string, size long, `key` string, runs string, slot int, n int, sums int, u long"


def corpus(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(300)] + ["Éa", "ñu", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts: list[str | None] = [None, "", " \t\n", "one", "one", "ONE", "two words", "a b c d", "a  b\tc\x0bd"]
    for n in (5, 30, 100, 400):
        base = text(n)
        texts += [base, base, base.upper() if n == 5 else base + " end", base.replace(" ", "\n")]
        words = base.split()
        for k in (1, n // 20, n // 8):
            changed = list(words)
            for _ in range(k):
                changed[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(changed))
    passage = text(90)
    for _ in range(12):
        texts.append(text(r.randint(0, 80)) + " " + passage[: r.randint(380, len(passage))] + " " + text(r.randint(0, 80)))
    texts += ["x" * 3000, "ab" * 700, text(9000), "é" * 500]
    rows = [(i, t, "en", ["s1", "s2", None, "s3"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[0]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "some words here", "a", 1, "k", "r", 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None), (2, "", "b", 0, "", "", 0, 0, 0, 0)]
    return spark.createDataFrame(rows, EXTRA)


def test_combine_sends_a_repeated_key_once():
    keys = np.array([5, 7, 5, 9, 5], np.uint64)
    sent, weight, hubs = combine(keys, np.arange(100, 105, dtype=np.uint64))
    assert sent.tolist() == [100, 7, 102, 9, 104] and weight.tolist() == [2, 1, 2, 1, 2] and hubs.tolist() == [5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7), (50, 60)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 -----------------------------------------------------------------------------------------------


def _viterbi(lines: list[str], model: dict) -> list[int]:
    score = None
    steps = chat_roles._steps(lines, True, model)
    back = []
    for m in steps:
        score = (np.zeros(chat_roles.S) if score is None else score)[:, None] + m
        back.append(score.argmax(axis=0))
        score = score.max(axis=0)
    path = [int(score.argmax())]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _likelihood(lines: list[str], path: list[int], model: dict) -> float:
    steps = chat_roles._steps(lines, True, model)
    return steps[0][0, path[0]] + sum(m[a, b] for m, a, b in zip(steps[1:], path, path[1:]))


def test_roles_follow_the_best_path_over_split_transcripts(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for conv in range(6):
        for turn in range([1, 3, 8, 40, 5, 2][conv]):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((conv, turn, role, "\n".join("word " * r.randint(1, 30) + r.choice(["", "?"]) for _ in range(r.randint(1, 4)))))
    rows += [(None, 0, "user", None), (None, 1, "assistant", ""), (9, 0, None, "User: x\nAssistant: y"), (9, 0, None, "User: x\nAssistant: y")]
    lines = transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    model = chat_roles.train(lines)
    monkeypatch.setattr(chat_roles, "STRETCH", 4)
    got = chat_roles.recover(lines, model).toPandas()
    plain = lines.toPandas()
    assert len(got) == len(plain)
    state = {s: i for i, s in enumerate(chat_roles.STATES)}
    for key in (0, 1, 2, 3, 4, 5):
        want = plain[plain["key"] == key].sort_values(["order", "line_no", "line"])
        have = got[got["key"] == key].sort_values(["order", "line_no"])
        path = [state[chat_roles.ROLES.index(x), int(b)] for x, b in zip(have["role"], have["begins"])]
        best = _viterbi(list(want["line"]), model)
        assert _likelihood(list(want["line"]), path, model) == pytest.approx(_likelihood(list(want["line"]), best, model))
    turns = chat_roles.render(chat_roles.recover(lines, model))
    assert turns.filter("rendered is null").count() == 0 and turns.filter("key is null").count() >= 1
    none = lines.limit(0)
    assert chat_roles.render(chat_roles.recover(none, chat_roles.train(none))).count() == 0


def test_roles_of_lines_without_marker_are_recovered(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("why is it so?" if t % 2 == 0 else "because of this. " * 20)) for c in range(60) for t in range(6)]
    lines = transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_roles.recover(lines, chat_roles.train(lines.filter("key % 2 = 0"))).filter("key % 2 = 1")
    truth = lines.select("key", "order", "line_no", F.col("role").alias("truth"))
    right = got.join(truth, ["key", "order", "line_no"]).select(F.avg((F.col("role") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.95


# 2 -----------------------------------------------------------------------------------------------


def _grams(text: str | None, width: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _classes(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = [_grams(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((repr(doc), len(s), repr(low.get(find(i)))) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def _got(df) -> list[tuple]:
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_similarity_classes(spark, docs, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(jaccard_join.classes(docs, width, percent)) == _classes(rows, width, percent)


def test_similarity_classes_with_frequent_grams_and_near_misses(spark, monkeypatch):
    """Many variants of few texts: n-grams are frequent, chains are cut by salts, and cross checks are needed."""
    monkeypatch.setattr(jaccard_join, "SALTS", 3)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 1)
    monkeypatch.setattr(jaccard_join, "PAIR_BLOCK", 3)
    r = random.Random(8)
    rows = []
    for base in range(3):
        words = [f"w{base}x{i}" for i in range(60)] if base else ["same"] * 5 + [f"v{i}" for i in range(50)]
        for _ in range(45):
            changed = list(words)
            for _ in range(r.randint(0, 4)):
                changed[r.randrange(len(words))] = f"y{r.randrange(12)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(None, rows[0][1]), (None, "alone here"), (5, "another text of a repeated id entirely different")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _got(jaccard_join.classes(df, 4, 85)) == _classes(rows, 4, 85)
    kept = jaccard_join.one_of_each(df, 4, 85)
    assert kept.columns == ["doc_id", "text"]
    firsts = {c for _, n, c in _classes(rows, 4, 85) if n}
    assert {repr(x["doc_id"]) for x in kept.collect()} == firsts | {"None"} or {repr(x["doc_id"]) for x in kept.collect()} == firsts


def test_similarity_classes_edges(nothing, clashing):
    assert jaccard_join.classes(nothing).count() == 0 and jaccard_join.one_of_each(nothing).count() == 0
    assert jaccard_join.classes(clashing).count() == 3
    assert jaccard_join.one_of_each(clashing).columns == clashing.columns


# 3 -----------------------------------------------------------------------------------------------


def _labelled(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [r.choice("the of and to in on for with is at house river stone cloud".split()) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[r.randrange(60)] = r.choice(["blorgface", "zonkhead"])
        rows.append((i, ", ".join(" ".join(words[k : k + 6]) for k in range(0, 60, 6)) + "."))
        labels.append((i, int(toxic)))
    rows += [(None, None), (601, ""), (602, "blorgface " * 20000), (5, rows[5][1])]
    labels += [(601, None), (None, 1), (5, labels[5][1]), (7, 2), (8, -1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.dropDuplicates(), "doc_id").filter(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).collect()
    assert len(got) > 80 and all(r["predicted"] == r["toxic"] == int(r["score"] >= 0.3) for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4) == 2 for r in got)
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels))
    assert kept.count() == docs.count() - 122 and kept.columns == docs.columns


def test_toxicity_edges(spark, nothing, clashing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(clashing, none)
    assert toxicity.score(clashing, model).filter("score between 0 and 1").count() == 3
    assert toxicity.score(nothing, model).count() == 0 and toxicity.drop_toxic(nothing, model).count() == 0
    assert toxicity.drop_toxic(clashing, model).columns == clashing.columns


def test_grammar_tells_kinds_of_clauses():
    match = toxicity.matcher({"blorg*": 2.0}, ["wuzzle"])
    kinds = lambda text: {k: v for k, v in zip(toxicity.KINDS, match(text)) if v}
    far = "stone river cloud house stone river cloud house"
    assert kinds("blorgface") == kinds("well, blorgface.") == {"edge": 2.0}
    assert kinds("you blorgface. fine") == kinds(f"{far} blorgface {far[:17]} you {far}") == {"addressed": 2.0}
    assert kinds("a wuzzle blorgface") == {"addressed": 2.0}  # a learned target
    assert kinds("blorgface, you") == {"edge": 2.0}  # another clause
    assert kinds("he is not a blorgface") == {"negated": 2.0}
    assert kinds("they said blorgface") == {"reported": 2.0}
    assert kinds("you will kill them") == {"threat": 1.0}
    # Deep in a clause, with no target near, nothing is said of anyone.
    assert kinds(f"{far} blorgface {far}") == kinds(f"{far} blorgface {far}, you") == kinds("") == {}
    assert kinds(f"{far} blorgface {far}. blorgface blorgface") == {"edge": 4.0}


def test_grammar_lets_threats_wait_for_a_target():
    match = toxicity.matcher({})
    assert match("i will kill you") == [0, 0, 0, 0, 1.0]
    assert match("you will kill you") == [0, 0, 0, 0, 1.0]
    assert match("i will not kill you") == [0, 0, 1.0, 0, 0]
    assert match("kill time") == match("kill, you") == match("kill a b c d e f you") == [0.0] * 5


def test_composed_transducers_against_all_paths():
    """Best paths weigh what the heaviest of all paths weighs, and composed paths are those of the two machines in turn."""
    first, second = toxicity.scopes(), toxicity.patterns(reach=2, edge=1)
    both = compose(first, second)
    runner = Runner(both)
    r = random.Random(6)
    symbols = [toxicity.OTHER, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT]
    for _ in range(300):
        clause = [r.choice(symbols) for _ in range(r.randrange(7))] + [toxicity.END]
        scale = [r.choice([0.5, 1.0, 2.0]) for _ in clause]
        found = [path for path, _ in paths(both, clause)]
        want = max(sum(a.weight * s for a, s in zip(path, scale)) for path in found)
        weight, written = runner.best(clause, scale)
        assert weight == pytest.approx(want)
        assert any([a.writes for a in p] == written and sum(a.weight * s for a, s in zip(p, scale)) == pytest.approx(want) for p in found)
        in_turn = Counter()
        for one, _ in paths(first, clause):
            for two, _ in paths(second, [a.writes for a in one]):
                in_turn[tuple((a.writes, a.weight + b.weight) for a, b in zip(two, one))] += 1
        assert in_turn == Counter(tuple((a.writes, a.weight) for a in p) for p in found)


def test_targets_are_learned_beside_insults(spark):
    r = random.Random(7)
    rows = []
    for i in range(400):
        said = [r.choice("river stone cloud house over under".split()) for _ in range(40)]
        for k in range(6, 40, 7):
            said[k] += ","
        for _ in range(3):
            at = r.randrange(38)
            said[at], said[at + 1] = "wuzzle", "blorgface"
        rows.append((" ".join(said), 1))
    frame = spark.createDataFrame(rows, "text string, toxic int")
    assert toxicity.learned_targets(frame, {"blorgface": 3.0}) == ["wuzzle"]


# 4 -----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, bigger = "<p>é</p>" * 200, "z" * 300_000
    rows = [(i, f"http://x/{i}", big) for i in range(8)] + [(20, None, None), (21, "a\r\nb", ""), (22, "u", "small"), (23, "u", "small"), (24, "u", bigger), (25, "u", bigger), (26, "u", "WARC/1.1\r\n\r\n" * 90)]
    rows += [(7, "http://x/7", big), (None, "n", big), (30, "x", "y" * 999), (31, "x", "y" * 999), (32, "x", "w" * 1000), (33, "x", "w" * 1000)]
    pages = spark.createDataFrame([(*r, 1, "e") for r in rows], "page_id long, url string, html string, digest int, `offset` string").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write(pages, path)
    index = warc.index(spark, path)
    assert index.count() == len(rows)
    back = warc.read(index).collect()
    kept = defaultdict(lambda: -1)
    for i, _, h in rows:
        kept[h or ""] = max(kept[h or ""], -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 1000 and i < kept[h or ""]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept[h or ""] if again else None, None if again else data))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    some = warc.read(index.filter("page_id in (22, 24)"), payload=False)
    assert sorted(r["page_id"] for r in some.collect()) == [22, 24]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_near_ranges_are_read_together():
    rows = [(0, 10), (14, 10), (200_000, 5), (200_009, warc.READ), (200_009 + warc.READ, 4)]
    assert [(a, b, h) for a, b, h in warc._ranges(rows)] == [(0, 24, [0, 1]), (200_000, 200_005, [2]), (200_009, 200_009 + warc.READ, [3]), (200_009 + warc.READ, 200_013 + warc.READ, [4])]


# 5 -----------------------------------------------------------------------------------------------


def test_packing(docs, nothing, clashing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), keep_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        by[r["doc_id"]].append((r["start"], ids.tolist()))
    source = Counter(r["doc_id"] for r in docs.collect())
    for r in docs.collect():
        want = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        got = [i for k, (_, ids) in enumerate(sorted(by[r["doc_id"]])) if k % source[r["doc_id"]] == 0 for i in ids]
        assert got == want
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    order = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert order == sorted(order)
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    assert packing.pack(clashing, tokenizer_path()).filter("doc_id is null").count() == 1


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "it's 12 héllo\n\n  wörld   ", "日本語 <|endoftext|>", "\x00\x01 tab\t"])
def test_both_tokenizer_paths_give_the_same_ids(text):
    from tokenizers import Tokenizer

    assert packing.encoder(tokenizer_path())(text) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit,size", [(" ", 1_000_000), (" ", 5_000_000), ("\n", 1_000_000), ("x", 1_000_000), ("é", 1_000_000), ("日", 300_000), ("-", 1_000_000), ("7", 1_000_000)])
def test_long_runs_give_the_ids_of_tokenizers(unit, size):
    from tokenizers import Tokenizer

    text = "a b " + unit * size + " c"
    assert packing.encoder(tokenizer_path())(text) == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "short")], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert len(got) == 2 and all(r["n"] == r["d"] for r in got)


def test_pieces_are_powers_of_two():
    assert packing.cut(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1] and packing.cut(7, 8) == [4, 2, 1] and packing.cut(1) == [1]
    with pytest.raises(ValueError):
        packing.pack(None, "", 100)


# 6 -----------------------------------------------------------------------------------------------


def test_permutation_index_recall_and_order(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 24))
    x[7] = x[8] = x[9]
    rows = [(int(i), [float(v) for v in np.float32(p)]) for i, p in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0] * 3), (None, [1.0] * 24), (5080, [1.0, None] + [0.0] * 22), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors, dim = permutation_index.usable(df)
    index, pivots = permutation_index.build(vectors, dim)
    got = permutation_index.search(index, pivots, dim, index.filter("vec_id % 20 = 0"), 20).toPandas()
    exact = np.array([p for _, p in rows[:1500]], np.float64)
    found = 0
    for q in range(0, 1500, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], score[mine["vec_id"]], rtol=1e-12)
        assert mine.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == mine["vec_id"].tolist()
        found += len(set(best) & set(mine["vec_id"]))
    assert len(got) == 75 * 20 and found / len(got) >= 0.9


def test_permutation_index_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for df, want in ((few, [2, 1]), (few.limit(0), [])):
        vectors, dim = permutation_index.usable(df)
        index, pivots = permutation_index.build(vectors, dim)
        got = permutation_index.search(index, pivots, dim, index.filter("vec_id = 0"), 20).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == want


# 7 -----------------------------------------------------------------------------------------------


def _cut(rows: list[tuple], width: int) -> list[tuple]:
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + width] for _, b in data for k in range(len(b) - width + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - width + 1):
            if times[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)])) if len(b) else 0
        out.append((repr(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [400, 60])
def test_repeats(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((repr(r[0]), *r[1:]) for r in repeats.report(docs, width).collect())
    assert got == _cut(rows, width)


def test_repeats_of_random_splices(spark):
    r = random.Random(11)
    parts = ["".join(r.choice("ab \n") for _ in range(r.randint(20, 500))) for _ in range(12)]
    rows = [(None if i % 9 == 0 else i, "".join(p[r.randint(0, 30) :] for p in r.sample(parts, r.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for width in (100, 300):
        assert sorted((repr(x[0]), *x[1:]) for x in repeats.report(df, width).collect()) == _cut(rows, width)


def test_repeats_tells_texts_of_one_id_apart(spark):
    r = random.Random(5)
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(70)
    rows = [(None if i % 2 else 7, letters(r.randint(20, 60)) + (passage + letters(40) if i % 4 < 2 else "")) for i in range(24_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((repr(x[0]), *x[1:]) for x in repeats.report(df, 60).collect()) == _cut(rows, 60)


def test_query_of_repeats_cuts_passages_of_over_50_words_beside_its_400_bytes(spark, tmp_path):
    r = random.Random(21)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(n))
    planted = {n: text(n) for n in (50, 51, 55, 60, 120)}
    assert len(planted[60]) < 400 < len(planted[120])
    own = {(n, k): (text(r.randint(0, 90)), text(r.randint(0, 90))) for n in planted for k in range(3)}
    rows = [(i, f"{own[n, k][0]} |{n}{k} {planted[n]} {k}{n}| {own[n, k][1]}") for i, (n, k) in enumerate(own)] + [(98, ""), (99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op7_repeats"](spark, str(tmp_path)).collect()
    assert sorted((repr(x[0]), *x[1:5]) for x in got) == _cut(rows, 400)
    got = {x["doc_id"]: x for x in got}
    for i, (n, k) in enumerate(own):
        a, b = own[n, k]
        want = rows[i][1] if n == 50 else f"{a} |{n}{k} {k}{n}| {b}"
        assert "".join(got[i]["text"].split()) == "".join(want.split())
        assert got[i]["n_cut"] == got[i]["n_bytes"] - len(got[i]["text"]) and (got[i]["n_cut"] > 0) == (n > 50) and (got[i]["n_removed"] > 0) == (n == 120)
    assert all((got[i]["text"], got[i]["n_cut"], got[i]["n_removed"]) == ("", 0, 0) for i in (98, 99))


def test_repeats_removed_from_texts(spark, nothing, clashing):
    passage = "é" * 250 + "".join(chr(97 + i % 26) for i in range(300))
    df = spark.createDataFrame([(1, f"start {passage}", 0), (2, f"{passage} stop", 1), (3, None, None), (4, "short", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in repeats.remove(df).collect()}
    assert got == {1: ("start ", 6), 2: (" stop", 5), 3: (None, None), 4: ("short", 5)}
    assert repeats.report(nothing).count() == 0 and repeats.remove(nothing).count() == 0
    assert repeats.remove(clashing).columns == clashing.columns and repeats.report(clashing).count() == 3


# 8 -----------------------------------------------------------------------------------------------


def _targets(sizes: dict, weights=(5, 2, 1), share=1.5) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_reaches_its_targets(docs):
    texts = docs.collect()
    got = mixing.decide(docs).collect()
    again = mixing.decide(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in texts:
        sizes[r["source"]] += size(r["text"])
    want = _targets(sizes)
    source, words = {r["doc_id"]: r["source"] for r in texts}, {r["doc_id"]: size(r["text"]) for r in texts}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        longest = max(words[i] for i in words if source[i] == s)
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s], longest / 2)
    rows = mixing.mix(docs)
    mixed = Counter()
    for r in rows.collect():
        mixed[r["source"]] += size(r["text"])
    assert mixed == +taken and rows.columns == docs.columns


def test_budget_filling_against_all_sums():
    r = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randint(1, 5))))
        counts = np.array([r.randint(1, 4) for _ in lengths])
        total = int((lengths * counts).sum())
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        budget = r.randint(0, total)
        take = mixing.fill_budget(lengths, counts, budget, 1)
        assert (take <= counts).all() and (take >= 0).all()
        best = min(abs(s - budget) for s in sums)
        assert abs(int((take * lengths).sum()) - budget) <= best + int(lengths.max())


@pytest.mark.parametrize("seed", ["mix", "a", "b", "c"])
def test_repeated_rows_are_taken_as_often_as_the_target_leaves(spark, seed):
    """Half of the source is one text under a null id; another source makes room for a target below two times its size."""
    rows = [(None, "w " * 10, "a", 1)] * 5000 + [(i, f"u{i} " * 10, "a", 1) for i in range(5000)] + [(i, "v " * 10, "b", 1) for i in range(10_000, 10_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, base int").repartition(7)
    got = mixing.decide(docs, weights=(5, 1), seed=seed)
    sums = {r["target"]: (r["n"], r["taken"]) for r in got.groupBy("target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()}
    assert {n for n, _ in sums.values()} == {10_000, 300}
    assert all(abs(taken - target) <= 10 for target, (_, taken) in sums.items())
    assert got.filter("taken > 2 * size or taken % size <> 0").isEmpty()
    again = mixing.decide(docs.repartition(3), weights=(5, 1), seed=seed)
    assert got.exceptAll(again).isEmpty() and again.exceptAll(got).isEmpty()
    mixed = mixing.mix(docs, weights=(5, 1), seed=seed)
    by_text = lambda df, n: {tuple(r)[:2]: r[2] for r in df.groupBy("doc_id", "text").agg(n).collect()}
    want = {k: v for k, v in by_text(got.join(docs.select("doc_id", "text").distinct(), got["doc_id"].eqNullSafe(docs["doc_id"])).select(got["doc_id"], "text", "taken"), F.sum("taken") / 10).items() if v}
    assert by_text(mixed, F.count("*").cast("double")) == want


def test_mix_edges(nothing, clashing, spark):
    assert mixing.decide(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.decide(clashing).filter("taken is null").count() == 0 and mixing.mix(clashing).columns == clashing.columns
    one = spark.createDataFrame([(i, "w " * 10, "a" if i < 3000 else "b") for i in range(6000)], "doc_id long, text string, source string")
    got = {r["t"]: r["s"] for r in mixing.decide(one).groupBy((F.col("doc_id") < 3000).alias("t")).agg(F.sum("taken").alias("s")).collect()}
    assert got == {True: 60000, False: 30000}


# 9 -----------------------------------------------------------------------------------------------


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    r = random.Random(6)
    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 70))) for _ in range(2))
        assert piecewise.edit_distance(a, b) == _distance(a, b)


def test_fingerprints_and_edited_texts(docs, nothing, clashing):
    rows = docs.collect()
    got = {(r["doc_id"], r["n_chars"]): r for r in piecewise.fingerprint_with_next(docs).collect()}
    assert piecewise.fingerprint_with_next(docs).count() == len(rows)
    ids = sorted({r["doc_id"] for r in rows})
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    twice = {i for i, n in Counter(r["doc_id"] for r in rows).items() if n > 1}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        if i in twice:
            continue
        t, f = text[i], text[following]
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        r = got[i, len(t)]
        own, new, after = (piecewise.fingerprints([x.encode()])[0] for x in (t, edited, f))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, new)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == piecewise.likeness(own, new) and r["near_next"] == piecewise.likeness(own, after)
        if len(t) > 500 and len(set(t)) > 5:
            assert r["near_edited"] >= 0.5
    assert piecewise.fingerprint_with_next(nothing).count() == 0 and piecewise.fingerprint_with_next(clashing).count() == 3
    alone = piecewise.fingerprint_with_next(docs.filter("doc_id = 20")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprint_format():
    made = piecewise.fingerprints([b"", b"x" * 100_000, b"ab", b"hello world " * 500])
    assert made[0] == "1::" and all(len(m.split(":")[1]) <= 64 for m in made)
    assert made == [piecewise.fingerprints([t])[0] for t in (b"", b"x" * 100_000, b"ab", b"hello world " * 500)]


# 10 ----------------------------------------------------------------------------------------------


def test_shards_take_turns():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill(names, 101)
    order = {i: [] for i in range(7)}
    for i, n in enumerate(names):
        at, skip = sharding._number(f"{n}/offset") % 101, sharding._number(f"{n}/skip") % 100 + 1
        order[i] = [(at + k * skip) % 101 for k in range(101)]
    plain: dict[int, int] = {}
    turn = 0
    while len(plain) < 101:
        i = turn % 7
        plain[next(s for s in order[i] if s not in plain)] = i
        turn += 1
    assert table == [plain[s] for s in range(101)]
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.fill(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, less) if a != 6) < 30
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100), (names, 5)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement_with_the_results_names(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "slot long, Shard string, n int")
    got = sharding.shard(rows, "slot", ["a", "b"]).collect()
    plain = {r["id"]: r["slot"] for r in sharding.shard(rows.selectExpr("slot as id", "n"), "id", ["a", "b"]).collect()}
    assert [r["slot"] for r in sorted(got, key=lambda r: r["n"])] == [plain[1], plain[2]]
    assert got[0].__fields__ == ["n", "slot", "shard", "shard_name"]


def test_placement(docs, nothing, clashing):
    names = [f"n{i}" for i in range(5)]
    rows = sharding.shard(docs, "doc_id", names, 101).collect()
    table = sharding.fill(names, 101)
    for r in rows:
        slot = int(hashlib.md5(f"k{r['doc_id']}".encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], names[table[slot]])
    assert sharding.shard(nothing, "doc_id", names, 101).count() == 0
    assert sharding.shard(clashing, "doc_id", names, 101).filter("shard is null").count() == 0

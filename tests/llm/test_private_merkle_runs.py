"""Personal data, Merkle manifests and word runs against brute-force versions, and on unusual rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strandlens.llm import merkle, private, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _plain(text: str) -> list[tuple]:
    out = []
    for kind, pattern in PATTERNS.items():
        for got in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", got[0])
            fits = {
                "email": True, "ip": all(int(x) <= 255 for x in got[0].split(".") if kind == "ip"),
                "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, *got.span()))
    return out


def test_plain_spans_against_the_stated_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("aA1@.-+ 0123456789().@._é\n") for _ in range(r.randrange(60)))
        assert [f[:3] for f in private.find(text) if f[3]] == _plain(text), text


CASES = [
    ("write to jane [at] mail (dot) example.org!", "email", "jane [at] mail (dot) example.org"),
    ("john dot smith at example dot com, now", "email", "john dot smith at example dot com"),
    ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
    ("é ｆｏｏ＠ｂａｒ．ｃｏｍ", "email", "ｆｏｏ＠ｂａｒ．ｃｏｍ"),
    ("x аdmin@example.com", "email", "аdmin@example.com"),  # begins with a Cyrillic letter
    ("call plus one five five five one two three four five six seven.", "phone", "plus one five five five one two three four five six seven"),
    ("call +1 (555) 5​55-1234", "phone", "+1 (555) 5​55-1234"),
    ("at one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("at 192 [dot] 168 [dot] 0 [dot] 1", "ip", "192 [dot] 168 [dot] 0 [dot] 1"),
    ("four one one one, 1111 1111 1111", "card", "four one one one, 1111 1111 1111"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("４１１１－１１１１－１１１１－１１１１", "card", "４１１１－１１１１－１１１１－１１１１"),
]


@pytest.mark.parametrize("text,kind,shown", CASES)
def test_disguised_spans_are_given_in_the_source(text, kind, shown):
    found = [f for f in private.find(text) if not f[3]]
    assert [(f[0], text[f[1] : f[2]]) for f in found] == [(kind, shown)]


@pytest.mark.parametrize("text", [
    "see me at example.com", "one of us, two of them and three more", "look at the dot", "the one two punch at noon.",
    "Sie ist um neun dort", "un dos tres", "price: 4111 1111", "v1.2.3", "1990–1995", "a@b", "[at] (dot)", "",
])
def test_clean_texts_have_no_spans(text):
    assert private.find(text) == []


def test_tapes_lead_back_through_every_transducer():
    """A span of what was written, taken at random, reads at least the characters it was written for, in order."""
    r = random.Random(5)
    alphabet = ["a", "1", "е", "​", "＠", " [at] ", " (dot) ", "one two three ", " dot ", "４", " "]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 15)))
        for step in (private.LOOKS, private.SPELLS, private.BRACKETS):
            tape = step.run(text)
            # Per written character, what it was read from: copied, or a whole edit.
            source, at = [], 0
            for (a, b), (c, d) in zip(tape.wrote, tape.read):
                source += [(at + k, at + k + 1) for k in range(c - at)] + [(c, d)] * (b - a)
                at = d
            source += [(k, k + 1) for k in range(at, len(text))]
            assert len(source) == len(tape.text)
            for a in range(len(source)):
                for b in range(a + 1, len(source) + 1):
                    assert tape.back((a, b)) == (source[a][0], source[b - 1][1])
            text = tape.text


@pytest.mark.parametrize("unit", ["a", "1", " ", "@", "a@", "+1(", "1.", "one ", " dot ", "a at b dot ", "​", "["])
def test_long_monotonous_texts_take_linear_time(unit):
    times = []
    for size in (100_000, 400_000):
        started = time.perf_counter()
        private.find(unit * (size // len(unit)))
        times.append(time.perf_counter() - started)
    assert times[1] < 12 * times[0] + 0.5


def test_numbers_with_very_many_digits():
    assert private.find("1." * 3 + "0" * 6000 + "7") == [("ip", 0, 6007, True)]
    assert private.find("1.2.3." + "9" * 6000) == []


def test_private_report_and_redaction(spark):
    card = "4111 1111 1111 1111"
    texts = [None, "", f"mail a.b@c.de, card {card}.", "jane [at] mail.org", "a@b.c_d@e.fg", "\U0001f600 10.0.0.1", "x" * 200_000 + " +49 (30) 1234567"]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)] + [(None, "a@b.c", "q", "q", 2)] + [(2, texts[2], None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email string, kind int").repartition(3)
    got = {(r["doc_id"], r["spans"]): r for r in private.report(docs).collect()}
    assert private.report(docs).count() == len(rows)
    assert got[2, "email:5:13,card:20:39"]["base_sha256"] == _sha("email:5:13,card:20:39")
    assert got[3, "email:0:18"]["n_disguised"] == 1 and got[3, "email:0:18"]["base_sha256"] == _sha("") and got[3, "email:0:18"]["n_email"] == 1
    assert (4, "email:0:5,email:5:12") in got and (5, "ip:2:10") in got and (6, "phone:200001:200017") in got and (None, "email:0:5") in got
    cleaned = {r["doc_id"]: r["text"] for r in private.redact(docs).collect()}
    assert cleaned[2] == "mail <EMAIL>, card <CARD>." and cleaned[3] == "<EMAIL>" and cleaned[0] == ""
    listed = {r["doc_id"]: r["spans"] for r in private.spans(docs).collect()}
    assert [tuple(s) for s in listed[2]] == [("email", 5, 13, True), ("card", 20, 39, True)] and listed[1] == []
    assert private.report(docs.limit(0)).count() == 0


# Merkle manifests


def _h(*parts: str) -> str:
    return _sha("".join(parts))


def _leaf(*values) -> str:
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes: list[str], fanout: int = 16) -> tuple[str, list[list[str]], list[list[tuple[int, list[str]]]]]:
    """The root, and per leaf its siblings per level with its place among them."""
    paths = [[] for _ in nodes]
    holds, level = [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        up, held = [], []
        for a in range(0, len(level), fanout):
            run = level[a : a + fanout]
            up.append(_h(*run))
            held.append([])
            for k, leaves in enumerate(holds[a : a + fanout]):
                for i in leaves:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
                held[-1] += leaves
        level, holds = up, held
    return level[0], paths


def _manifest(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for doc_id, text, lang, source, n in rows:
        leaf = _leaf(doc_id, source, lang, n, text)
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, text, lang, n))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: r[:3])
        trees[s] = _tree([r[2] for r in groups[s]])
    root, above = _tree([trees[s][0] for s in order])
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, doc_id, text, lang, n) in enumerate(groups[s]):
            path = trees[s][1][i] + above[k]
            folded = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                folded = _leaf(doc_id, s, lang, n, None if text is None else text.translate(lower))
            for place, others in path:
                folded = _h(*others[:place], folded, *others[place:])
            proof = _h(*(x for _, others in path for x in others))
            out.append((doc_id, leaf, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _got(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _rows(sizes: dict, seed: int = 0) -> list[tuple]:
    r, out = random.Random(seed), []
    for source, size in sizes.items():
        for _ in range(size):
            doc_id = len(out) * 7 % 10_007
            out.append((doc_id, r.choice([None, "", "Some Text ñ", "lower", f"T{doc_id}"]), r.choice([None, "en"]), source, r.choice([None, 3])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16, None: 17}, {"a": 300, "b": 1, "": 2, None: 16, "é": 33, "z": 256},
    {f"s{i}": 1 + i % 3 for i in range(40)}, {"hot": 1111, "b": 5},
])
def test_manifest(spark, levels, sizes):
    """Blocks of few leaves, so that a butterfly has several rounds, with partners that are missing."""
    rows = _rows(sizes)
    got = _got(merkle.of_documents(spark.createDataFrame(rows, DOCS).repartition(5), levels=levels))
    assert got == _manifest(rows)


def test_manifest_of_repeated_ids_and_rows(spark):
    rows = _rows({"a": 40, None: 20})
    rows += rows[:10] + [(None, "Null id", None, "a", None)] * 3 + [(rows[0][0], "other text", None, rows[0][3], 1)] + [(5, "x" * 300_000 + "Y", "en", "long", 1)]
    docs = spark.createDataFrame([(*r, 1, "b", "c") for r in rows], DOCS + ", rank int, _at string, leaf string").repartition(4)
    assert _got(merkle.of_documents(docs)) == _manifest(rows)
    assert merkle.of_documents(docs.limit(0)).count() == 0


def test_butterfly_rounds(spark):
    """Every partner ends with the same top and with its own siblings, at every count of partners around powers."""
    sizes = [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 273, 290, 512, 530]
    rows = [(t, k, n, _h(f"{t}.{k}")) for t, n in enumerate(sizes) for k in range(n)]
    got = merkle.exchange(spark.createDataFrame(rows, "tree long, node long, n long, hash string")).collect()
    assert len(got) == len(rows)
    trees = {t: _tree([_h(f"{t}.{k}") for k in range(n)]) for t, n in enumerate(sizes)}
    for r in got:
        root, paths = trees[r["tree"]]
        assert r["top"] == root and r["above"] == ["".join(others) for _, others in paths[r["node"]]]


def test_kept_proofs_fold_to_the_root(spark):
    docs = spark.createDataFrame(_rows({"a": 50, "b": 3}), DOCS)
    for r in merkle.of_documents(docs, keep_proofs=True).collect():
        assert _sha("".join(r["proof"])) == r["proof_sha256"]
        assert r["verified"] == (r["folded_root"] == r["root"])


# Runs of words


def _all_runs(text: list, least: int, times: int) -> list[tuple]:
    out, n = [], len(text)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if text[i] != text[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and text[i] == text[i + q]:
                i += 1
            piece = text[s : i + q]
            if len(piece) >= max(least, times * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((s, len(piece), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(2000):
        n, k = r.randrange(60), r.choice([1, 2, 3])
        text = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.5 and n > 5:
            a, p = r.randrange(n), r.randrange(1, 6)
            for i in range(a + p, n):
                text[i] = text[i - p]
        least, times = r.choice([2, 4, 8, 24]), r.choice([2, 3])
        assert runs.runs_of(text, least, times) == _all_runs(text, least, times)


def test_paths_take_the_colours_of_their_last_access():
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 40)
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        paths, last = runs.Paths(parent), [-1] * n
        for colour in range(60):
            v, want = r.randrange(n), []
            x = v
            while x >= 0:
                if last[x] >= 0 and (not want or want[-1][0] != last[x]):
                    want.append((last[x], x))
                last[x] = colour
                x = parent[x]
            assert list(paths.access(v, colour)) == want


def _report(rows: list[tuple], least: int = 24, times: int = 3) -> list[tuple]:
    out = []
    for doc_id, text, *_ in rows:
        said = WORD.findall(text or "")
        n = len(said)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            said = [w if i < a else said[a + (i - a) % p] for i, w in enumerate(said)]
        found = _all_runs(said, least, times)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None,) * 3
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(said) if i not in gone)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        out.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, _sha(listed), _sha(kept)))
    return sorted(out, key=str)


def _texts() -> list[str | None]:
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdéB") for _ in range(r.randint(1, 3)))
    some = lambda n: [word() for _ in range(n)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a\x0b" * 25 + "b", " a a"]
    for _ in range(150):
        parts: list[str] = []
        for _ in range(r.randint(1, 5)):
            parts += some(r.randint(0, 40))
            unit = some(r.randint(1, 30))
            parts += (unit * 8)[: r.randint(0, 5 * len(unit))]
        texts.append(r.choice([" ", "\n", "  "]).join(parts))
    inner = ["x"] * 30 + ["y"]
    return texts + [" ".join(inner * 5), " ".join(some(4000)), " ".join((some(700) * 4)[:2500])]


def test_report_of_runs(spark):
    rows = [(i, t) for i, t in enumerate(_texts())] + [(None, "q r " * 20), (3, "one"), (9, "A a " * 15)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, runs string, start int, n_runs int").repartition(4)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted((tuple(r[c] for c in names) for r in runs.report(docs, runs.looped).collect()), key=str)
    want = _report(rows)
    assert got == want and sum(r[1] for r in want) > 60
    assert runs.report(docs.limit(0), runs.looped).count() == 0


def test_runs_and_collapsed_texts(spark):
    text = "start " + "a b c " * 10 + "end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no  run")], "doc_id long, text string")
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.runs(docs).collect()} == {1: [(1, 30, 3)], 2: [], 3: []}
    assert {r["doc_id"]: r["text"] for r in runs.collapse(docs).collect()} == {1: "start a b c end", 2: "", 3: "no run"}


def test_a_text_of_one_word_over_and_over(spark):
    docs = spark.range(1).select(F.lit(4).cast("long").alias("doc_id"), F.expr("repeat('same ', 200000)").alias("text"))
    r = runs.report(docs).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, 0, 200_000, 1)

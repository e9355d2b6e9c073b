"""The pipeline's stages on the smallest driver tables, each against brute force over its own input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from strandlens.llm import packing
from strandlens.llm.catalog import tokenizer_path
from strandlens.llm.frames import stage

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], str(SF)), f"test-{name}"))
    return out


def test_stages_keep_the_columns_of_documents(results):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "packing"]
    for df in results[1:-1]:
        assert df.schema == results[0].schema


def test_near_copies_leave_one_of_each_class(results):
    rows = {r["doc_id"]: r["text"] for r in results[1].collect()}
    grams = {}
    for i, t in rows.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            both = len(grams[a] & grams[b])
            if a < b and both and 100 * both >= 80 * (len(grams[a]) + len(grams[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in results[2].collect()} == {i for i in rows if find(i) == i}


def _without_repeats(texts: list[str], width: int = 400, passage: int = 51) -> list[str]:
    """By brute force: without the bytes of every string of ``width`` bytes, and of every ``passage`` words, that starts anywhere else."""
    data = [t.encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    strings = Counter(b[k : k + width] for b in data for k in range(len(b) - width + 1))
    said = [[b[x:y] for x, y in s] for b, s in zip(data, spans)]
    passages = Counter(tuple(w[k : k + passage]) for w in said for k in range(len(w) - passage + 1))
    out = []
    for b, s, w in zip(data, spans, said):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if strings[b[k : k + width]] > 1:
                gone[k : k + width] = b"1" * width
        for k in range(len(w) - passage + 1):
            if passages[tuple(w[k : k + passage])] > 1:
                x, y = s[k][0], s[k + passage - 1][1]
                gone[x:y] = b"1" * (y - x)
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore"))
    return out


def test_repeats_are_cut_and_sources_mixed(results):
    before = results[2].collect()
    want = dict(zip([r["doc_id"] for r in before], _without_repeats([r["text"] or "" for r in before])))
    got = {r["doc_id"]: r["text"] or "" for r in results[3].collect()}
    assert got == want and any(len(t) < len(r["text"] or "") for r, t in zip(before, want.values()))
    size = defaultdict(int)
    for r in results[3].collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    taken = Counter()
    copies = Counter()
    for r in results[4].collect():
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
        copies[r["doc_id"]] += 1
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.02 * sum(size.values())
    assert max(copies.values()) <= 2 and all(taken[s] <= 2 * size[s] for s in size)


def test_packing_holds_every_token(spark, results):
    ids = packing.encoder(tokenizer_path())
    want = sum(len(ids(r["text"] or "")) + 1 for r in results[4].collect())
    rows = results[5].collect()
    assert sum(r["length"] for r in rows) == want and len({r["sequence_id"] for r in rows}) == len(rows)
    assert corpus_pipeline.run(spark, str(SF)).count() == len(rows)


def test_repeated_passages_of_over_50_words_are_cut(spark):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(n))
    planted = {n: text(n) for n in (50, 51, 55, 60)}
    assert max(len(p) for p in planted.values()) < 400
    planted[400] = "z" + "".join(r.choices("abcdefghij", k=450))  # no words, but 400 bytes
    own = {(n, k): (text(r.randint(0, 90)), text(r.randint(0, 90))) for n in planted for k in range(3)}
    rows = [(i, f"{own[n, k][0]} |{n}{k} {planted[n] if k else planted[n].replace(' ', chr(10))} {k}{n}| {own[n, k][1]}", "en", "s", 0) for i, (n, k) in enumerate(own)]
    rows += [(99, None, "en", "s", None), (98, "", "en", "s", 0), (97, " \n", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    grams = lambda t: {tuple(w[k : k + 51]) for w in [WORD.findall(t or "")] for k in range(len(w) - 50)}
    seen = Counter(g for t in got.values() for g in grams(t))
    assert all(n == 1 for n in seen.values())
    for i, (n, k) in enumerate(own):
        a, b = own[n, k]
        if n == 50:
            assert got[i] == rows[i][1]
        else:
            assert "".join(got[i].split()) == "".join(f"{a} |{n}{k} {k}{n}| {b}".split())
    assert got[99] is None and got[98] == "" and got[97] == " \n"

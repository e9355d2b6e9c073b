"""The queries of this package on the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_roles, jaccard_join, merkle, mixing, packing, permutation_index, piecewise, private, repeats, runs, sharding, toxicity, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def transcripts(conversations: DataFrame) -> DataFrame:
    """Lines of raw transcripts made from the turns: seven of ten turns open with one of several spellings of a speaker
    marker, the others with none. role and begins are what a reader of the lines doesn't see."""
    u = F.pmod(F.xxhash64(F.lit("marker"), "conv_id", "turn"), F.lit(10))
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(3)).cast("int") + 1
    spelled = {"system": ("System: ", "[context]: ", "Instructions - "), "user": ("User: ", "Human: ", "Q: "), "assistant": ("Assistant: ", "AI: ", "A: ")}
    marker = F.lit("")
    for role, ways in spelled.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, ways)), style)).otherwise(marker)
    text = F.concat(F.when(u < 7, marker).otherwise(""), F.coalesce("text", F.lit("")))
    lines = chat_roles.lines_of(conversations.withColumn("text", text), "conv_id", "turn", "text", "role")
    return lines.withColumn("begins", F.col("line_no") == 0)


@query
def op1_chat_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The model is fitted on (a sample of) the very transcripts that it then recovers; see the tests for accuracy on others."""
    lines = transcripts(table(spark, sf, "conversations"))
    turns = chat_roles.render(chat_roles.recover(lines, chat_roles.train(lines)))
    return turns.withColumnsRenamed({"key": "conv_id", "order": "turn"})


@query
def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf, "documents"), width=4, percent=85)


ORACLE["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                      ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * o >= 85 * (i.n + j.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1
"""


@query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
"""


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query
def op6_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    vectors, dim = permutation_index.usable(table(spark, sf, "embeddings"))
    index, pivots = permutation_index.build(vectors, dim)
    return permutation_index.search(index, pivots, dim, index.filter("vec_id % 20 = 0"), 20)


@query
def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.report(table(spark, sf, "documents"), keep_text=True, passage=repeats.PASSAGE)


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.decide(table(spark, sf, "documents"))


@query
def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return piecewise.fingerprint_with_next(table(spark, sf, "documents"))


@query
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard", "shard_name", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


ORACLE["op10_sharding"] = f"""
WITH filled AS (SELECT string_split('{",".join(map(str, sharding.fill(SHARDS)))}', ',') AS t),
placed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         (('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot
  FROM documents
)
SELECT doc_id, slot, t[slot + 1]::INTEGER AS shard, 'shard-' || lpad(t[slot + 1], 2, '0') AS shard_name, n_bytes
FROM placed, filled
"""


@query
def op11_private_data(spark: SparkSession, sf: str) -> DataFrame:
    return private.report(table(spark, sf, "documents"))


@query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.of_documents(table(spark, sf, "documents"))


def _merkle_sql(levels: int) -> str:
    """The tree level by level: so many levels below the subroots, which serves 16 ** levels documents a source, and below the root."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    body = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    small = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    # A CRC-32 is worked out a digit at a time, each by eight steps of the shift register.
    shift = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    rounds = ", ".join(f"b{k} AS (SELECT doc_id, s, pos, {shift} AS c FROM b{k - 1})" for k in range(1, 9))
    out = f"""WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 1 AS pos, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL (
  WITH b0 AS (SELECT doc_id, s, pos + 1 AS pos, xor(c, ascii(s[pos])::BIGINT) AS c FROM crc WHERE pos <= length(s)), {rounds}
  SELECT doc_id, s, pos, c FROM b8)
), picked AS (
  SELECT doc_id FROM crc WHERE pos > length(s) AND xor(c, 4294967295) % 5 = 0
), d AS (
  SELECT doc_id, source, sha256({body} || {field("text")}) AS leaf,
         CASE WHEN doc_id IN (FROM picked) THEN sha256({body} || {field(small)}) END AS shown FROM documents
), l0 AS (
  SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, doc_id, leaf, shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), n0 AS (SELECT src, i, leaf AS h FROM l0)"""

    def climb(out: str, name: str, tree: str) -> str:
        for k in range(levels):
            out += f""",
{name}g{k} AS (SELECT {tree}, i // 16 AS i, list(h ORDER BY i) AS run, sum(count(*)) OVER (PARTITION BY {tree}) > 1 AS more FROM {name}{k} GROUP BY 1, 2),
{name}{k + 1} AS (SELECT {tree}, i, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM (
  SELECT {tree}, i, run, more OR len(run) > 1 AS more FROM {name}g{k}))"""
        return out

    def fold(out: str, rows: str, name: str, tree: str, at: str) -> tuple[str, str]:
        for k in range(levels):
            new = f"{rows}_"
            out += f""",
{new} AS (
  SELECT r.* EXCLUDE (proof, folded, {at}), r.{at} // 16 AS {at},
         CASE WHEN g.more THEN proof || array_to_string(run[:r.{at} % 16] || run[r.{at} % 16 + 2:], '') ELSE proof END AS proof,
         CASE WHEN g.more THEN sha256(array_to_string(run[:r.{at} % 16] || [folded] || run[r.{at} % 16 + 2:], '')) ELSE folded END AS folded
  FROM {rows} r JOIN (SELECT {tree}, i, run, more OR len(run) > 1 AS more FROM {name}g{k}) g ON g.{tree} = r.{tree} AND g.i = r.{at} // 16)"""
            rows = new
        return out, rows

    out = climb(out, "n", "src")
    out += f""",
t0 AS (SELECT 0 AS top, src AS i, h FROM n{levels})"""
    out = climb(out, "t", "top")
    out += """,
p AS (SELECT *, 0 AS top, src AS j, '' AS proof, coalesce(shown, leaf) AS folded FROM l0)"""
    out, rows = fold(out, "p", "n", "src", "i")
    out, rows = fold(out, rows, "t", "top", "j")
    return out + f"""
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = t.h AS verified
FROM {rows} r JOIN n{levels} s ON s.src = r.src CROSS JOIN t{levels} t
"""


ORACLE["op12_merkle"] = _merkle_sql(5)


@query
def op13_word_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.report(table(spark, sf, "documents"), runs.looped)

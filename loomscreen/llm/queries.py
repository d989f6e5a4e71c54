"""The corpus queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, conversations, decontam, html, jaccard, langid, quality, shards, substring, tokenfile, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, counts and checksums of all documents' ids as read from the files."""
    docs = table(spark, sf_dir, "documents")
    return tokenfile.read_back(tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents")
    net = langid.learn(docs.where(F.coalesce(langid.fold("doc_id", 4) != 2, F.lit(False))))
    return langid.predict(docs, net).select(F.col("key").alias("doc_id"), F.coalesce(langid.fold("key", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; fold 0 of 5 is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = quality.learn(docs, labels.where(langid.fold("doc_id", 5) != 0))
    return quality.score(docs, chain).select(
        F.col("key").alias("doc_id"), F.coalesce(langid.fold("key", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, for 24 shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents")
    dims = [shards.coded(F.col("source")), shards.coded(F.col("lang")), F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(8))]
    return shards.assign(docs, dims, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op1_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT vec_id AS query_id, max(v) AS q FROM usable WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(q, v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM queries, usable WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no repeated window of 35 words covers."""
    return substring.dedup(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS s FROM split WHERE len(w) >= 35),
windows AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS body FROM starts JOIN split USING (r)),
repeated AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY body) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM repeated),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM split LEFT JOIN lists USING (r)
"""


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and number of links of every document: five-word shingles, similarity of 0.8 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"))


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM split WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE c * 1000 >= 800 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT r AS a, r AS b FROM split UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
classes AS (SELECT a AS r, min(doc_id) AS class_id FROM reached JOIN split ON split.r = b GROUP BY a),
counts AS (SELECT a AS r, count(*) AS n FROM edges GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM split JOIN classes USING (r) LEFT JOIN counts USING (r)
"""


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and where."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"), F.min("start_word").alias("start_word"), F.max("n_words").alias("n_words"))


ORACLES["op4_decontaminate"] = r"""
WITH items AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
long_items AS (SELECT item_id, w, len(w) AS length FROM items WHERE len(w) >= 5),
item_shingles AS (
  SELECT item_id, length, j - 1 AS o, array_to_string(w[j:j + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, length - 3)) AS j FROM long_items)),
item_counts AS (SELECT item_id, shingle, count(*) AS n FROM item_shingles GROUP BY ALL),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
doc_shingles AS (
  SELECT r, j - 1 AS p, array_to_string(w[j:j + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS j FROM docs WHERE len(w) >= 5)),
hits AS (
  SELECT DISTINCT d.r, s.item_id, d.p, s.length, least(greatest(d.p - s.o, 0), greatest(len(w) - s.length, 0)) AS start
  FROM doc_shingles d JOIN item_shingles s USING (shingle) JOIN docs USING (r)),
starts AS (SELECT DISTINCT r, item_id, length, start FROM hits),
counts AS (
  SELECT s.r, s.item_id, s.length, s.start, c.shingle, least(count(*), any_value(c.n)) AS n
  FROM starts s JOIN doc_shingles d ON d.r = s.r AND d.p BETWEEN s.start AND s.start + s.length - 5
  JOIN item_counts c ON c.item_id = s.item_id AND c.shingle = d.shingle
  GROUP BY ALL),
scored AS (
  SELECT r, item_id, c.length, start, sum(n) AS common, any_value(least(c.length, len(w)) - 4 + c.length - 4) - sum(n) AS every
  FROM counts c JOIN docs USING (r) GROUP BY r, item_id, c.length, start),
best AS (
  SELECT doc_id, r, item_id, length, start, common / every AS similarity,
    row_number() OVER (PARTITION BY r, item_id ORDER BY common / every DESC, start) AS k
  FROM scored JOIN docs USING (r) WHERE common * 1000 >= every * 800)
SELECT doc_id, item_id, round(max(CAST(similarity AS DOUBLE)), 6) AS similarity, CAST(min(start) AS INTEGER) AS start_word, CAST(max(length) AS INTEGER) AS n_words
FROM best WHERE k = 1 GROUP BY doc_id, item_id
"""


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; fold 1 of 3 is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(langid.fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        F.col("key").alias("doc_id"), F.coalesce(langid.fold("key", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every damaged conversation, and the cheapest edits that repair it."""
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(rows, copies="copies").withColumnRenamed("key", "conv_id")


def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    """SQL for a path of cost c, audit a and text o, one edit longer."""
    text = f"CASE WHEN {state}.o = '' THEN {line} ELSE {state}.o || chr(10) || {line} END" if line else f"{state}.o"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', o := {text})"


def _repair_sql() -> str:
    insert_user, insert_assistant = (lambda s, r=r: _edit(s, "5", "I", f"'{r}:'") for r in ("user", "assistant"))
    keep = lambda s, initial: f"CASE WHEN NOT gone AND ini = '{initial}' THEN {_edit(s, 'extra', 'K', 'role || chr(58) || text')} END"
    rerole = lambda s, role: f"CASE WHEN NOT gone THEN {_edit(s, '1 + extra', 'R', repr(role + ':') + ' || text')} END"
    to_user = ", ".join(x for s in ("z0", "zs", "za") for x in (keep(s, "u"), rerole(s, "user")))
    least = lambda *found: f"list_min([{', '.join(found)}])"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substring(key, i, 1)) AS BIGINT)),
      lambda crc, code: list_reduce(range(1, 9), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, code)), 4294967295)) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k, substring(role, 1, 1) AS ini FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN k > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows_ AS (SELECT conv_id, i, role, text, ini, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := CAST(0 AS BIGINT), a := '', o := '') AS z0,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS zs, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS zu, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS za FROM counts
  UNION ALL
  SELECT conv_id, i, {_edit("z0", "2", "D")}, {least(_edit("zs", "2", "D"), keep("z0", "s"))}, {least(_edit("zu", "2", "D"), to_user)},
    {least(_edit("za", "2", "D"), keep("zu", "a"), rerole("zu", "assistant"))}
  FROM (SELECT * REPLACE ({least("za", insert_assistant("zu"))} AS za) FROM (
    SELECT * EXCLUDE (u) REPLACE ({least("zu", insert_user("z0"), insert_user("zs"), insert_user("za"))} AS zu) FROM (
      SELECT p.conv_id, r.* EXCLUDE (conv_id), p.z0, p.zs, p.zu, p.za, 0 AS u FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)))),
ends AS (
  SELECT conv_id, {least("z0", "za", insert_assistant("zu"), insert_assistant("y"))} AS z
  FROM (SELECT p.*, {insert_user("zs")} AS y FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(z.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLES["op12_conversation_repair"] = _repair_sql()

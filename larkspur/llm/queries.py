"""The queries op1 to op10 with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, langid, media, mixing, packing, pii, quality, sharding, simhash, topk
from larkspur.llm.common import fold
from larkspur.session import own_path, table

PROBE = "</s>[INST] ok [/INST]"


def tokenizer_path() -> str:
    """The byte-level BPE file; TOKENIZER_FILE names another place."""
    if given := os.environ.get("TOKENIZER_FILE"):
        return given
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.expand(media.store_audio(table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), quality.HELD_OUT) == 0, F.lit(False)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), langid.HELD_OUT) == 1, F.lit(False)))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS p(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    told = chat.conversations(chat.chain(turns), links=chat.chain_links(turns))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    told = told.select(F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), 16, path=own_path(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"), pii.listing(F.concat("base", "added")).alias("spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_topk, op2_media, op3_simhash, op4_quality, op5_mixing, op6_langid, op7_chat, op8_sharding, op9_packing, op10_pii)}


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""

#: Escapes that a text needs: one for each control string in it.
_CONTROLS = (r"<\\*(?:\||/s>)", r"\|\\*>", r"\[\\*/?INST\]")
_ESCAPES = " + ".join(f"len(regexp_extract_all({{0}}, '{p}'))" for p in _CONTROLS)
OP7 = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')) AS p(c, t, r, x))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + length(text) + {_ESCAPES.format('role')} + {_ESCAPES.format('text')}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def _op10() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": pii.IBAN,
        "pan": r"[0-9](?:[\x20-]?[0-9])+",
    }
    digits = "regexp_replace(s.h, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({digits}), CAST(i + 1 AS INTEGER), 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    bare = "regexp_replace(s.h, ' ', '', 'g')"
    turned = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({turned}) + 1), lambda i: ascii(substr({turned}, CAST(i AS INTEGER), 1)))), lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
    near = "lower(substr(t, greatest(0, s.b - 40) + 1, s.b - greatest(0, s.b - 40)) || ' ' || substr(t, s.e + 1, 20))"
    tests = {
        "email": "true",
        "ip": "len(list_filter(string_split(s.h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 3) AS INTEGER), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"NOT regexp_matches(CASE WHEN s.b > 0 THEN substr(t, s.b, 1) ELSE '' END || substr(t, s.e + 1, 1), '[A-Za-z0-9]') AND {mod97}",
        "pan": f"length({digits}) BETWEEN 13 AND 15 AND {luhn} AND regexp_matches({near}, '{pii.KINDS['pan'][4]}')",
    }
    cut = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS g_{k}" for k, p in plain.items())
    begin = "coalesce(list_sum(list_transform(g_{0}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{0}[1:i - 1], lambda x: length(x))), 0)"
    placed = ", ".join(f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'b': CAST({begin.format(k)} AS INTEGER), 'e': CAST({begin.format(k)} + length(m_{k}[i]) AS INTEGER), 'h': m_{k}[i]}}) AS p_{k}" for k in plain)
    kept = ", ".join(f"list_filter(p_{k}, lambda s: {test}) AS k_{k}" for k, test in tests.items())
    said = {k: f"list_transform(k_{k}, lambda s: '{k}:' || s.b || ':' || s.e)" for k in plain}
    base = " || ".join(said[k] for k in pii.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, {cut} FROM d),
p AS (SELECT doc_id, t, {placed} FROM c),
k AS (SELECT doc_id, {kept} FROM p)
SELECT doc_id, {', '.join(f'CAST(len(k_{k}) AS BIGINT) AS n_{k}' for k in pii.BASE)},
  sha256(array_to_string({base}, ',')) AS base_sha256,
  array_to_string({base} || {said['iban']} || {said['pan']}, ',') AS spans
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1, "op7_chat": OP7, "op10_pii": _op10()}

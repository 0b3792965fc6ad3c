"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, fingerprints, html_text, language_model, lexical, media, neardup, packing, piece_bpe, secrets, sharding, topk, toxicity

#: Toxicity from which a document is predicted toxic.
THRESHOLD = 0.3


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def secret_words() -> list[str]:
    """The dictionary of the secret scan."""
    return secrets.known_words(tokenizer_path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards whose row counts are at most one apart and whose sources mix alike (see sharding.shard for nulls, ties and repeats)."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out; predicted from THRESHOLD on. Null ids are not held out; see toxicity.tag."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.is_held_out(), F.lit(False)).alias("held_out")
    return toxicity.tag(docs, model).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the 32k piece model; null counts as empty (see piece_bpe.encode_table)."""
    return piece_bpe.encode_table(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates by counted five-word shingles (see neardup.near_duplicates)."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by the base and by the log-bilinear model of the rows that are not held out (see language_model.score)."""
    return language_model.score(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image, found again in its page and read back (see media.interleave)."""
    return media.interleave(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096 (see packing.pack_documents)."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for each vector whose id is divisible by 50 (see topk.search)."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a candidate secret in every whole text, with its score (see secrets.scan)."""
    return secrets.scan(_table(spark, sf_dir, "documents"), known=secret_words())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page (see html_text.extract)."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's phrase fingerprint, beside those of its edited form and of the next document (see fingerprints.fingerprints)."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item (see lexical.search)."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired at the least cost (see conversations.repair)."""
    return conversations.repair(_table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: A-Z are lowered before the terms are cut, which takes none of them away.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), a AS (
  SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_all FROM d WHERE len(ts) > 0
), q AS (
  SELECT item_id, t, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL
), p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, n_docs
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_all))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), a GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_toxicity, op3_sentencepiece, op4_near_duplicates, op5_language_model, op6_media, op7_packing, op8_topk, op9_secrets, op10_html_text, op11_fingerprints, op12_lexical_search, op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL, "op12_lexical_search": OP12_SQL}

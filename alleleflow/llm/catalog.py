"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleflow.llm import (
    decontaminate, divergence, licences, lines, manifest, manifest_sql, multi_index, packing, pii, sharding, simhash, substrings, toxicity, wavelet)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    """Benchmark items that documents contain."""
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark, sf_dir):
    """Words of all documents that no repeated 35-word window covers."""
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), 35).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_line_dedup(spark, sf_dir):
    """All documents, one line kept of each component of similar lines."""
    return lines.remove_similar_lines(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_simhash(spark, sf_dir):
    """Components of documents whose fingerprints differ in at most four bits."""
    return simhash.components(_read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark, sf_dir):
    """Personal data in all documents."""
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def op7_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.scores(docs, model, "doc_id").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sharding(spark, sf_dir):
    """All documents in 24 shards of near-equal bytes."""
    return sharding.assign(_read(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_wavelet(spark, sf_dir):
    """All documents written as wavelet-matrix shards and read back."""
    return wavelet.digests(wavelet.read_documents(wavelet.write_shards(_read(spark, sf_dir, "documents"))))


def op10_multi_index(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    return multi_index.search(_read(spark, sf_dir, "embeddings"))


def op11_manifest(spark, sf_dir):
    """Merkle manifest of all documents, each leaf folded up to the root after tampering."""
    return manifest.audit(_read(spark, sf_dir, "documents"))


def op12_divergence(spark, sf_dir):
    """How far the sources of each language lie apart, and the terms that mark each source."""
    return divergence.divergence(_read(spark, sf_dir, "documents"))


#: The definition itself, over every kept term of every pair.
DIVERGENCE_SQL = r"""WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
hits AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM hits GROUP BY ALL HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce(g.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs l USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) g USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.total + 5) // (g.lang_n + 5 * g.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50"""


def op13_licences(spark, sf_dir):
    """Licences of all documents."""
    return licences.digest(licences.scan(_read(spark, sf_dir, "documents"), "doc_id"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_substring_dedup, op4_line_dedup, op5_simhash,
                                    op6_pii, op7_toxicity, op8_sharding, op9_wavelet, op10_multi_index, op11_manifest, op12_divergence, op13_licences)}
ORACLES: dict[str, str] = {"op11_manifest": manifest_sql.AUDIT, "op12_divergence": DIVERGENCE_SQL}

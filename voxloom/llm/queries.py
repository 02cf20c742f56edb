"""The queries of this subpackage by name, each an operator with its production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import collocations, conversations, decontaminate, licenses, order_minhash, packing, pages, prob_minhash, quality, secrets, sharding, substrings, token_counts
from voxloom.llm.common import documents, table, text_of


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_edits(table(spark, sf_dir, "documents"))


def op4_prob_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE units AS (
  SELECT text, min(doc_id) AS unit_id FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text
), split AS (
  SELECT unit_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM units
), shingles AS (
  SELECT DISTINCT unit_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT unit_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT unit_id, count(*) AS n FROM shingles GROUP BY unit_id
), shared AS (
  SELECT a.unit_id AS a, b.unit_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.unit_id < b.unit_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.unit_id = a JOIN sizes y ON y.unit_id = b WHERE s.n >= 0.8 * (x.n + y.n - s.n)
), reach AS (
  SELECT unit_id AS id, unit_id AS label FROM units
  UNION
  SELECT e.b, r.label FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.id
), classes AS (
  SELECT id, min(label) AS class_id FROM reach GROUP BY id
)
SELECT d.doc_id, u.unit_id, c.class_id FROM documents d JOIN units u ON u.text = coalesce(d.text, '') JOIN classes c ON c.id = u.unit_id
"""


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    rows = docs.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"], shards=40, seed=20)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return secrets.scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.every_limit(token_counts.suffix_sums(token_counts.length_histogram(docs)))


def op10_rabin_karp_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_intervals(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50)
), repeated AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS least FROM windows) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM repeated) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words ELSE [words[p] FOR p IN range(1, len(words) + 1) IF NOT list_contains(places, p)] END AS words
  FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""


def op11_minimum_cut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_apriori_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM placed, range(1, 4) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM candidates c JOIN range(1, 3) t(cut) ON cut < c.k
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
  SELECT lang, inner_phrase AS phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM candidates WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
  WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
)
SELECT k.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_prob_minhash_near_duplicates": OP4_SQL, "op10_rabin_karp_passages": OP10_SQL, "op13_apriori_collocations": OP13_SQL}

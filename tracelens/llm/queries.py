"""The registered queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .chat_format import digests, format_turns, turns_of_records, turns_of_table
from .chunks import short_batches
from .decontaminate import contaminated
from .jaccard_join import jaccard_components
from .lm_scoring import score_documents
from .periodic_runs import periodic_runs, plant_runs
from .quality_classifier import classify
from .quality_rules import judge
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .token_counts import count_tokens, vocabulary_path
from .token_files import stored_tokens
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    record = F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(hard).alias("content")) for r in ("user", "assistant")]).alias("messages")))
    one = turns_of_records(spark.range(1).select(F.lit(-7).cast("long").alias("id"), record.alias("record")), "id", "record")
    turns = turns_of_table(_table(spark, sf_dir, "conversations")).unionByName(one)
    return digests(format_turns(turns))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(plant_runs(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_suffix_array_dedup, op2_benchmark_decontamination, op3_token_counts, op4_quality_classifier, op5_quality_rules,
        op6_substring_dedup, op7_ngram_jaccard_join, op8_byte_bpe, op9_chat_formatting, op10_lm_scoring,
        op11_token_files, op12_embedding_whitening, op13_periodic_runs)}


#: Word windows as lists; the smallest doc_id of each, then the words that earlier ones cover.
OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 49] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, (SELECT unnest(range(0, 50)) AS j)),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN p.v END, ' ' ORDER BY p.i), '') AS t
  FROM (SELECT doc_id, unnest(ws) AS v, unnest(range(1, len(ws) + 1)) AS i FROM w) p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


#: Shingle lists, pairs that share enough of them, and everything a document reaches.
OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.doc_id),
low AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN low ON low.doc_id = d.doc_id
"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</', '<\/')"
_HARD = r"\### Assistant: </turn> ok"
#: Turns in order, what the template adds and escapes, and the assistant's texts.
OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
    CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(replace({_ESCAPED.format('r')}, ':', '\\c')) + length({_ESCAPED.format('t')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6, "op7_ngram_jaccard_join": OP7, "op9_chat_formatting": OP9}

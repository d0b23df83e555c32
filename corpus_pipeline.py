"""The training-text pipeline: stages over `documents`, each written and read again.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns what goes on. All but the last
return the columns of `documents`. The last gives each document's token ids, after they were decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.bpe import encode_documents
from tracelens.llm.chunks import short_batches
from tracelens.llm.decontaminate import drop_contaminated
from tracelens.llm.jaccard_join import jaccard_components
from tracelens.llm.quality_classifier import keep_good
from tracelens.llm.suffix_dedup import dedup_suffixes
from tracelens.llm.token_counts import vocabulary_path
from tracelens.session import materialize


#: Bytes of an Arrow batch, so that two workers of a core and their JVM stay small.
BATCH_BYTES = 8 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; every row is judged by its own text, repeated ids and rows alike."""
    short_batches(spark, size=BATCH_BYTES)
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, per_cent: int = 80) -> DataFrame:
    """The document of the smallest id of each component of the Jaccard join (shingles of ``words`` words) stays.

    Defined cases: a null id is in no component, so such rows stay; of several rows of one id in one component one stays (the
    least hash of the text; equal rows once); a text without words is a component of its own, apart from other texts of
    its id; an empty table gives no rows.
    """
    short_batches(spark, size=BATCH_BYTES)
    found = materialize(jaccard_components(docs, k=words, t=per_cent, with_text_hash=True).where("doc_id = component_id"))
    kept = found.groupBy("doc_id", (F.col("n_shingles") > 0).alias("_words")).agg(F.min("text_hash").alias("_hash")).select("doc_id", "_hash").distinct()
    again = found.groupBy("doc_id", F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count")
    name = _unused("text_hash", docs)
    keyed, keys = docs.withColumn(name, F.xxhash64("text")), ["doc_id", name]
    kept, again = (x.withColumnRenamed("_hash", name) for x in (kept, again))
    once = keyed.join(kept, keys, "left_semi")
    if not again.isEmpty():  # only such rows are shuffled whole
        once = once.join(again, keys, "left_anti").unionByName(once.join(again, keys, "left_semi").dropDuplicates(keys))
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that an earlier document has are cut out; documents with nothing left go.

    Defined cases: rows of one id aren't cut against each other; a null id counts as the greatest; null and empty texts stay as they are.
    """
    short_batches(spark, size=BATCH_BYTES)
    others = [c for c in docs.columns if c != "text"]
    null = _unused("text_is_null", docs)
    out = dedup_suffixes(docs.withColumn(null, F.when(F.col("text").isNull(), True)), along=(*others, null)).where("n_removed = 0 OR n_removed < n_bytes")
    cut = {"text": F.when(F.col(f"rest.`{null}`").isNull(), F.col("kept_text"))}
    cut["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[cut.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go; every row is judged by its own text, null and empty ones stay."""
    short_batches(spark, size=BATCH_BYTES)
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, and digests of the ids and of the decoded text; a row each, whatever its id."""
    short_batches(spark, size=BATCH_BYTES)
    return encode_documents(docs, vocabulary_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_text),
          ("benchmark decontamination", benchmark), ("byte-level BPE encoding and decoding", tokens)]
#: Not given: SQL can state neither the classifier nor the encoding. tests/llm/test_pipeline.py compares each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each written before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

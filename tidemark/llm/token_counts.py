"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the tokenizer's version.  Texts are joined to
the cache by these digests, only distinct misses are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.chunk_dedup import slices
from tidemark.llm.storage import materialize

SCHEMA = "digest binary, n_tokens bigint, tokenizer string"


def tokenizer_digest(tokenizer: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it: a new version of either shares no counts."""
    library = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)}\n".encode())
    with open(bpe.tokenizer_path(tokenizer), "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def counter(tokenizer: str):
    """A function from texts to token counts, without begin, end or added special tokens."""
    path = bpe.tokenizer_path(tokenizer)
    if path.endswith(".model"):
        import sentencepiece

        model = bpe._loaded.get(path) or bpe._loaded.setdefault(path, sentencepiece.SentencePieceProcessor(model_file=path))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    codec = bpe.load(path)
    return lambda texts: [len(x) for x in bpe.encode_long(codec, texts)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an empty table where none was written yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _counts(cache: DataFrame, version_digest: str) -> DataFrame:
    """One row per digest: two runs at once may both have appended it."""
    return cache.where(F.col("tokenizer") == version_digest).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str = "byte_bpe_50k.json",
    doc_id: str = "doc_id",
    text: str = "text",
    most_broadcast: int = 100_000,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row, after the cache at ``cache_path`` has gained what it lacked.

    Normalised content is the text with null as empty and nothing else changed, as any other change could change the count.  The append is one
    Spark job and thus whole or absent when executors are lost.  Repeated rows and copies are encoded once.  Up to
    ``most_broadcast`` missing digests (32 bytes each) pick their texts where these are read; more of them meet the distinct texts in a join.
    """
    spark = docs.sparkSession
    now = tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    missing = materialize(docs.select(digest).distinct().join(_counts(read_cache(spark, cache_path), now), "digest", "left_anti"), "missing")
    n_missing = missing.count()
    keyed = docs.select(digest, content.alias("text"))
    if n_missing <= most_broadcast:
        keyed = keyed.join(F.broadcast(missing), "digest", "left_semi")
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if n_missing > most_broadcast:
        misses = misses.join(missing, "digest", "left_semi")

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count(texts[lo:hi]), pa.int64())], names=["digest", "n_tokens"])

    if n_missing:
        fresh = misses.mapInArrow(run, "digest binary, n_tokens bigint")
        fresh.withColumn("tokenizer", F.lit(now)).write.partitionBy("tokenizer").mode("append").parquet(cache_path)
    # Written out, so that the join below has a plain table on either side and a digest of many copies can be split.
    known = materialize(_counts(read_cache(spark, cache_path), now), "counts")
    asked = docs.select(F.col(doc_id).alias("doc_id"), digest, F.octet_length(content).cast("long").alias("n_bytes"))
    return asked.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")

"""Token counts through a digest cache.

A text is known by the SHA-256 of its content (null counts as the empty text),
a tokenizer by the SHA-256 of its file, its library version and its options.
Both digests are joined to the stored counts; of the contents that are not
stored yet each is encoded once, and its count is appended to the cache.  Digests
alone are compared and moved: texts are encoded where they lie, whatever their
number.  A Bloom filter of (digest, first id) tells the tasks which rows; a row
that passes it by chance is encoded in vain, and its count is dropped.

Edge cases: a null or empty text has 0 bytes and 0 tokens.  Rows whose ids
repeat or are null keep one result row each.  An empty table gives no rows and
appends nothing.  Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom, bloom_of
from .common import by_bytes, leanly, materialise, pick, shared_dir, table
from .word_tokens import default_path, word_encoder

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
OVER = 2048
MAP_BITS = (20, 28)  # of the filter of misses: 128 kB to 32 MB
REMEMBER = 1_000_000


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|add_special_tokens=False".encode()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The stored counts, or None where nothing was stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest the task has not met among the last ``REMEMBER`` different ones."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(d)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def fill_cache(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends the counts of contents that the cache lacks; doc_id, n_bytes, content_digest of each row."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    rows = pick(docs, doc_id=id_col, content=text_col).withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("content_digest", F.sha2("content", 256))
    keyed = materialise(rows.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "content_digest"))
    # Digests alone decide what is to be encoded, and where: by the first row that has a content.
    wanted = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("first"))
    known = read_cache(spark, cache_path)
    if known is not None:
        wanted = wanted.join(known.where(F.col("tokenizer_digest") == version).select("content_digest"), "content_digest", "left_anti")
    misses = materialise(wanted)

    if not misses.limit(1).count():
        return keyed
    sent = spark.sparkContext.broadcast(bloom_of(materialise(misses.select(F.xxhash64("content_digest", "first").alias("mark"))), MAP_BITS))

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Bloom(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array(marks.has(batch.column(2).to_numpy())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in by_bytes(_first_seen(missed(batches)), 1, 1 << 20):
            counts = encoder.count_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    # The row with the first id of a content stands for all its copies.
    texts = rows.select("content_digest", "content", F.xxhash64("content_digest", "doc_id").alias("mark"))
    new = materialise(texts.mapInArrow(leanly(encode, "words"), CACHE_SCHEMA).dropDuplicates(["content_digest"]))
    new.join(misses, "content_digest", "left_semi").select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache_path)
    return keyed


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), content_digest; fills the cache at ``cache_path``."""
    keyed = fill_cache(docs, cache_path, tokenizer_path, id_col, text_col)
    stored = read_cache(docs.sparkSession, cache_path)
    if stored is None:  # no rows, so nothing was stored
        stored = docs.sparkSession.createDataFrame([], CACHE_SCHEMA)
    # Of the cache only what this call asks for, as a table of its own: both sides of the last join are plain exchanges, and a hot digest's rows can be split.
    stored = stored.where(F.col("tokenizer_digest") == tokenizer_digest(tokenizer_path)).join(keyed.select("content_digest").distinct(), "content_digest", "left_semi")
    counts = materialise(stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    return keyed.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills a cache, then answers every row from it: the second call finds all digests stored and encodes nothing."""
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    fill_cache(docs, path, default_path())
    return count_tokens(docs, path, default_path())

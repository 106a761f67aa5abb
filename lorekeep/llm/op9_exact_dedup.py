"""Exact duplicates through content-defined chunk recipes; DataFrame functions only.

A text is normalised (each run of white space becomes one space) and cut where
its content says so: a chunk has 512 characters at least and ends after the next
cut mark, or after 4096 characters.  Cut marks: a word that ends in one of four letter pairs, a
semicolon or brace before a space, some pairs of a digit and a letter (for texts without words), a word of
another script with spaces, and some characters of scripts without (in few ranges, as long
classes are slow).  Texts that share a passage so share the chunks inside it.

Every distinct chunk moves once: the chunk store deals them by hash and chunk
and finds the 64-bit hashes that stand for more than one chunk.  A hash that
stands for one chunk is its verified identifier; the others are replaced by the
chunk's SHA-256.  A document is then an ordered list of identifiers, its recipe,
and two texts are equal when their recipes are.  Only recipes are grouped and
compared; whole texts do not move.

Edge cases: null counts as the empty text, whose recipe is empty.  Of rows with
the same text and the same doc_id exactly one is kept.  Null doc_ids come after
all others; if a group has no other, keep_id is null and one of its rows is
kept.  An empty table gives no rows.  Other columns are ignored by
``exact_dedup`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered, pick, place, table

# A run of white space that is not already a single space.
RUN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
MARKS = r"[eo][nt]\x20|[;}]\x20|[07][AKak]|[\u0370-\u2FFF]\x20|[\u3001\u3002\u306E\u4E00-\u4E3F\u6200-\u623F\u7684\u8FD9-\u8FFF\uAC00-\uAC3F\uB2E4]"
CHUNK = rf"(?s).{{512,4096}}?(?:{MARKS})|.{{1,4096}}"
MOST_COLLISIONS = 10_000

ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_store(docs: DataFrame, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """hash, chunk: each distinct chunk of all documents once."""
    every = docs.select(F.explode(chunks(normalised(F.col(text_col)))).alias("chunk"))
    return every.select(hash_of(F.col("chunk")).alias("hash"), "chunk").distinct()


def identifier(store: DataFrame, hash_of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """What stands for a chunk in recipes, verified against the store."""
    shared = materialise(store.groupBy("hash").count().where("count > 1").select("hash"))
    # Of n chunks about n * n / 2 ** 65 share a 64-bit hash; beyond the limit no hash is used at all.
    collisions = [r["hash"] for r in shared.limit(MOST_COLLISIONS + 1).collect()]
    if not collisions:
        return hash_of
    if len(collisions) > MOST_COLLISIONS:
        return lambda c: F.sha2(c, 256)
    return lambda c: F.when(hash_of(c).isin(collisions), F.sha2(c, 256)).otherwise(hash_of(c).cast("string"))


def recipes(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_sha256, recipe, copies: rows that agree in doc_id and text count as copies of one."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    name = identifier(chunk_store(docs, "text", hash_of), hash_of)
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    listed = text.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), lambda c: name(c)).alias("recipe"))
    return materialise(listed.groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies")))


def decide(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text_sha256, copies, keep_id, group_size: a row for each doc_id and text."""
    own = recipes(docs, id_col, text_col, hash_of)
    groups = own.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = materialise(groups)  # then both sides of the join are plain exchanges, and a hot recipe's rows can be split
    return own.join(groups, "recipe").drop("recipe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``."""
    rows = decide(docs, id_col, text_col, hash_of).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    first = decide(docs, id_col, text_col, F.xxhash64).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = materialise(first.select("keep_id", F.col("text_sha256").alias("sha"), "copies"))
    plain = numbered(docs)  # c0, c1 and so on, beside which no other name can clash
    key, text = (F.col(f"c{place(docs, c)}") for c in (id_col, text_col))
    rows = plain.withColumn("own", F.sha2(normalised(text), 256))

    def matching(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, key.eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("sha")), "left_semi")

    out = matching(first.where("copies = 1"))
    repeated = first.where("copies > 1")
    if repeated.limit(1).count():
        out = out.union(matching(repeated).dropDuplicates(["own"]))
    return out.select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))

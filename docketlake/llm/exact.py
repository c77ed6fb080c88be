"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are compared whole in each of three steps. Rows are combined by text within the task that reads them; what a task
has left goes by (digest, salt, text) to the mergers, the salt being that of the reading task, so a text that every task
holds is spread over ``salts`` of them; the winners of the salts, at most ``salts`` a text, are combined by (digest, text).
A digest that proves to stand for one text then leads each row to its class without its text; rows of digests that stand
for several are joined by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_classes, saved

#: Rows of one repeated doc_id that are made from their count at once.
_BLOCK = 10_000


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def combined(rows: DataFrame, salts: int) -> DataFrame:
    """One row a text of ``rows`` (doc_id, text, digest): digest, text, keep_id (least doc_id), n (rows)."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = merged.repartition("digest")
    return winners.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, salts: int = 64, digest=sha256) -> DataFrame:
    """Each row's class of texts that are equal after white space runs become one space; the least doc_id stays.

    One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. A null text is an empty
    one. Rows without doc_id stay only where no row of their class has one, and then one of them; of rows that repeat the
    least doc_id with the same text one stays. An empty table gives no rows; further columns are ignored.
    ``digest``, any function of the text, only deals rows out: texts of one digest are told apart by content.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = texts.withColumn("digest", digest(F.col("text")))
    ids = saved(rows.select("doc_id", "digest", sha256(F.col("text")).alias("sha")))
    groups = combined(rows, salts)
    each = saved(groups.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.sum("n").alias("group_size")))
    found = join_classes(ids, each.where("texts = 1").drop("texts"), "digest", ids.count())
    shared = each.where("texts > 1").select("digest")
    if not shared.isEmpty():
        own = rows.join(shared, "digest", "left_semi")
        both = own.alias("r").join(combined(own, salts).alias("c"), [F.col("r.digest") == F.col("c.digest"), F.col("r.text") == F.col("c.text")])
        found = found.unionByName(both.select("r.doc_id", "r.digest", sha256(F.col("r.text")).alias("sha"), "c.keep_id", F.col("c.n").alias("group_size")))
    return _one_kept(found.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256")))


def _one_kept(rows: DataFrame) -> DataFrame:
    """``rows`` with kept: true for one of the rows whose doc_id is the class's keep_id, made again from their count."""
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    counted = rows.where(own).groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(_BLOCK))))
    nth = F.sequence(F.col("_from"), F.least(F.col("_n"), F.col("_from") + _BLOCK) - 1)
    first = blocks.withColumn("_nth", F.explode(nth)).withColumn("kept", F.col("_nth") == 0)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return rows.where(~own).withColumn("kept", F.lit(False)).select(columns).unionByName(first.select(columns))


def keep_first(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of a repeated row one. Rows without doc_id stay if their text has no other."""
    kept = exact_duplicates(docs, salts).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_own", F.lower(F.hex(sha256(normalised(F.col("text"))))))
    stays = marked.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_own") == F.col("_sha")), "left_semi")
    return stays.dropDuplicates(["doc_id", "_own"]).drop("_own")


SQL = """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
    row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""

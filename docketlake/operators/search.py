"""Search for any part of a text by an index of its short strings: a search reads the blocks of rows that have them, not the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import blob
from .rank import keep_top

SIZE = 3
#: Stands behind a text, so that each of its strings of one or two characters begins one of three.
END = "\0" * (SIZE - 1)


def grams(text: Column) -> Column:
    """The different strings of three characters in ``text``."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{SIZE}}}))"), 1))


def _bucket(value: str | Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], path: str, buckets: int = 64, block_rows: int = 256) -> None:
    """Write the index of ``rows`` over these columns to ``path``: texts in blocks, the strings of three characters in each block, their counts.

    ``key`` names the rows, which should be unique by it. Blocks are dealt by a hash of the key and hold some ``block_rows``
    rows. A string is held once a block, however many of its rows have it, so postings grow with the blocks and the
    different strings, not with the length of the texts.
    """
    texts = rows.select(F.col(key).alias("id"), blob(rows, columns).alias("text")).where(F.col("id").isNotNull())
    blocks = buckets * -(-texts.count() // (buckets * block_rows)) or buckets
    dealt = texts.withColumn("block", _bucket("id", blocks)).withColumn("part", F.col("block") % buckets)
    dealt.repartition("block").sortWithinPartitions("part", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
    spark = rows.sparkSession
    strings = spark.read.parquet(f"{path}/texts").select("block", F.explode(grams(F.concat("text", F.lit(END)))).alias("gram")).distinct()
    postings = strings.withColumn("bucket", _bucket("gram", buckets))
    postings.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/settings")


def search(spark: SparkSession, path: str, questions: DataFrame, rarest: int = 8) -> DataFrame:
    """(qid, id): the rows of the index at ``path`` whose text has a question's text anywhere in it, without regard to case.

    questions (qid, text), trimmed; a blank one finds nothing. Candidates are the blocks that have all of the ``rarest``
    least frequent strings of the question, or any string that begins with a question of one or two characters; their
    texts are then searched, so the result is exact, whatever ``rarest`` is.
    """
    buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]
    counts, postings = spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/postings")
    asked = questions.select("qid", F.lower(F.trim("text")).alias("asked")).where("asked <> ''")
    long = F.length("asked") >= SIZE
    wanted = asked.where(long).select("qid", F.explode(grams(F.col("asked"))).alias("gram")).withColumn("bucket", _bucket("gram", buckets))
    counted = wanted.join(counts, ["bucket", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = keep_top(counted, ["qid"], rarest, F.col("n"), F.col("gram"), name="nth").select("qid", "bucket", "gram")
    needed = kept.groupBy("qid").agg(F.count("*").alias("needed"))
    hits = postings.join(kept, ["bucket", "gram"]).groupBy("qid", "block").agg(F.count("*").alias("have"))
    hits = hits.join(needed, "qid").where("have = needed").select("qid", "block")
    begun = counts.join(F.broadcast(asked.where(~long)), F.col("gram").startswith(F.col("asked"))).select("qid", "bucket", "gram")
    hits = hits.unionByName(postings.join(begun, ["bucket", "gram"]).select("qid", "block").distinct())
    found = spark.read.parquet(f"{path}/texts").join(hits.withColumn("part", F.col("block") % buckets), ["part", "block"]).join(asked, "qid")
    return found.where(F.contains("text", "asked")).select("qid", "id")

"""Helpers shared by the training-data operators: inputs, intermediate tables, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def work_folder(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir``, else below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else f"{spark.conf.get('spark.sql.warehouse.dir')}/_llm_work"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later result reads."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bits_for(rows: int, per_bucket: int) -> int:
    """Number of leading hash bits that cut ``rows`` into buckets of about ``per_bucket`` rows."""
    return max(0, (max(rows, 1) // per_bucket).bit_length())


def numbered(df: DataFrame, groups: list[str], order: Column, bits: int, name: str) -> DataFrame:
    """Gapless number from 0 within ``groups``, in the order of a signed 64-bit hash ``order``.

    The top ``bits`` of the hash cut every group into slices; slices are numbered on their own and
    shifted by the size of the slices before, so no task holds a whole group. The offset table has
    groups x 2^bits lines. ``groups`` must not be null.
    """
    cut = df.withColumn("_hash", order).withColumn(
        "_slice", F.shiftright("_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    inside = W.partitionBy(*groups, "_slice").orderBy("_hash")
    before = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cut.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (cut.withColumn("_row", F.row_number().over(inside))
            .join(offsets, [*groups, "_slice"])
            .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long"))
            .drop("_hash", "_slice", "_row", "_before"))


#: A key with this fraction of all rows or more is "hot"; there are at most so many hot keys.
HOT_SHARE = 1000


def join_skewed(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a table of one line per ``key``: hot keys by broadcast, the rest by a shuffle.

    ``hot`` holds the keys with a thousandth of all rows or more, so at most 1000 lines are broadcast
    and no task gets the rows of a hot key. ``how``: inner or left_anti.
    """
    ids = F.broadcast(hot.select(key))
    cold = rows.join(ids, key, "left_anti").join(table.join(ids, key, "left_anti"), key, how)
    if how == "left_anti":
        return cold
    return cold.unionByName(rows.join(F.broadcast(table.join(ids, key, "left_semi")), key))


def connected(edges: DataFrame) -> DataFrame:
    """Nodes ``v`` and the smallest node ``m`` of their component, from edges (a, b) of longs.

    Alternates large-star and small-star steps until the edges are stars; every step is a partially
    aggregated minimum by node and a join back, written to the shared folder. Nodes that are their
    component's smallest are not returned. Rounds grow with the logarithm of the component size.
    """
    state = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
                   .where("v <> m").distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)")))
    before = state.select(mark.alias("x")).first()["x"]
    while before[0]:
        both = state.select(F.col("v").alias("u"), F.col("m").alias("w")).union(state.select("m", "v"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("least"))
        large = (both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m"))
                 .where("v <> m").distinct())
        # small star: a node's smaller neighbours, and itself, point to the smallest of them
        large = stored(large, "edges")
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = (large.join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
                 .union(least.select("v", F.col("least").alias("m"))).where("v <> m").distinct())
        after = stored(small, "edges")
        now = after.select(mark.alias("x")).first()["x"]
        discard(state)
        discard(large)
        state = after
        if now == before:
            break
        before = now
    return state

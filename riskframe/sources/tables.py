"""Scans, integrity guards and sinks for the loan tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import MISSING, nan_to_null
from riskframe.sources.schema import (APPLICATION_CATEGORICALS, APPLICATION_FILES, CHILD_FILES,
                                      KEY, child_type, column_type)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system behind ``path``, so cloud and cluster paths work too."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def require_sources(spark: SparkSession, folder: str, mode: str = "train",
                    extension: str = "csv") -> dict[str, str]:
    """Paths of the seven sources; raises with the list of those missing."""
    if mode not in APPLICATION_FILES:
        raise ValueError(f"mode must be one of {sorted(APPLICATION_FILES)}, got {mode!r}")
    names = {"application": APPLICATION_FILES[mode], **CHILD_FILES}
    paths = {table: f"{folder}/{name}.{extension}" for table, name in names.items()}
    missing = [p for p in paths.values() if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing source files: " + ", ".join(missing))
    return paths


def _csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One source with declared types; CSV and Parquet look the same afterwards.

    CSV columns are matched by header position, so every header column gets a type: the declared
    one, or for columns the schema does not know, a number or text as the name tells.
    """
    def wanted(name: str) -> T.DataType:
        return column_type(name) if table == "application" else child_type(table, name)

    if path.endswith(".parquet"):
        frame = spark.read.parquet(path)
        return nan_to_null(frame.select(*[
            F.col(f"`{c}`").cast(wanted(c)).alias(c) for c in frame.columns]))
    fields = [T.StructField(c, wanted(c)) for c in _csv_columns(spark, path)]
    # header=False reads the header as data; it is on, and the schema replaces inference
    frame = spark.read.option("header", True).schema(T.StructType(fields)).csv(path)
    return nan_to_null(frame)


def load_tables(spark: SparkSession, folder: str, mode: str = "train",
                extension: str = "csv") -> dict[str, DataFrame]:
    """All seven tables, application text columns enforced, application key checked."""
    paths = require_sources(spark, folder, mode, extension)
    tables = {table: read_table(spark, path, table) for table, path in paths.items()}
    tables["application"] = as_text(tables["application"], APPLICATION_CATEGORICALS)
    assert_primary_key(tables["application"], KEY)
    return tables


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Row count, NULL keys and surplus rows of a key column, as one row.

    Counting per key first keeps the distinct count a plain two-step aggregate.
    """
    return (df.groupBy(key).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                 F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0))
                 .alias("null_keys"),
                 F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0))
                 .alias("surplus_rows")))


def assert_primary_key(df: DataFrame, key: str) -> None:
    report = key_report(df, key).first()
    if report["null_keys"]:
        raise ValueError(f"{report['null_keys']} NULL values in key {key}")
    if report["surplus_rows"]:
        raise ValueError(f"{report['surplus_rows']} duplicate values in key {key}")


def assert_same_rows(before: DataFrame, after: DataFrame, step: str) -> None:
    """Guard against a join that multiplied or lost rows."""
    n_before, n_after = before.count(), after.count()
    if n_before != n_after:
        raise ValueError(f"{step}: {n_before} rows became {n_after}")


def keep_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key exists in the parent."""
    return child.join(parent.select(key), key, "left_semi")


def history_frames(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Column-pruned child tables for the history features.

    Balance rows of unknown loans are dropped by the inner join.
    """
    loans = tables["bureau"].select("SK_ID_BUREAU", KEY).distinct()
    balances = tables["bureau_balance"].select("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS")
    payments = tables["installments"].select(
        KEY, "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT", "AMT_PAYMENT", "AMT_INSTALMENT")
    return {
        "bbal": balances.join(loans, "SK_ID_BUREAU"),
        "inst": payments.withColumn(
            "days_past_due", F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")),
        "cc": tables["credit_card"].select(
            KEY, "MONTHS_BALANCE", "AMT_BALANCE",
            F.col("AMT_CREDIT_LIMIT_ACTUAL").alias("AMT_CREDIT_LIMIT"),
            "AMT_DRAWINGS_ATM_CURRENT"),
        "prev": tables["previous_application"].select(
            KEY, "CODE_REJECT_REASON", "NAME_GOODS_CATEGORY", "RATE_INTEREST_PRIMARY"),
    }


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def write_store(df: DataFrame, folder: str, meta: dict | None = None,
                compact: bool = False) -> None:
    """Feature store: Parquet rows plus a JSON sidecar with the column list and fitted values."""
    if compact:
        df = df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})
    df.write.mode("overwrite").parquet(f"{folder}/features")
    _write_text(df.sparkSession, f"{folder}/store.json",
                json.dumps({"columns": df.columns, **(meta or {})}))


def read_store(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    meta = "\n".join(r["value"] for r in spark.read.text(f"{folder}/store.json").collect())
    return spark.read.parquet(f"{folder}/features"), json.loads(meta)


def reuse_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """Read an intermediate table if a finished write exists, otherwise build and write it."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def align_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the stored column list; absent columns become the sentinel."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(MISSING).alias(c) for c in columns])


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Metric tables as JSON lines or CSV."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)

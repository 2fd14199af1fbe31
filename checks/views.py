"""Loan-shaped views over the generic test tables, as DataFrames and as SQL.

The generic tables stand in for the loan tables row by row: no view drops rows. NULLs
come from attribute values (a quantity of 1 means "unpaid"), so the missing-value
rules are exercised. ``SQL`` holds the same views for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRESENT = "2001-08-02"   # application date for orders and lineitem
EVENTS_END = "2024-01-30"  # application date for events


class Tables:
    """Lazy access to one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def applicants(self) -> DataFrame:
        bal, nat, key = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
        seg = F.col("c_mktsegment")
        credit = (bal + 1000) * 25
        return self.raw("customer").select(
            key.alias("SK_ID_CURR"),
            (bal < 0).cast("int").alias("TARGET"),
            F.when(bal > 9900, 0.0).when((seg == "MACHINERY") & (nat < 4), None)
            .otherwise(F.abs(bal) * 10).alias("AMT_INCOME_TOTAL"),
            credit.alias("AMT_CREDIT"),
            F.when(nat == 7, None).otherwise(credit / (12 + nat)).alias("AMT_ANNUITY"),
            F.when(seg == "FURNITURE", None).otherwise(credit * 0.9).alias("AMT_GOODS_PRICE"),
            (-7000 - key * 131 % 18000).cast("int").alias("DAYS_BIRTH"),
            F.when((seg == "HOUSEHOLD") & (nat < 8), 365243).otherwise(-(key * 97 % 9000))
            .cast("int").alias("DAYS_EMPLOYED"),
            F.when(seg == "BUILDING", None).otherwise(key * 7919 % 10007 / 10007.0)
            .alias("EXT_SOURCE_1"),
            F.when(nat < 3, None).otherwise((nat + 1) / 30.0).alias("EXT_SOURCE_2"),
            F.when((seg == "AUTOMOBILE") & (bal > 5000), None).otherwise(F.abs(bal) / 10000)
            .alias("EXT_SOURCE_3"),
            (seg == "BUILDING").cast("int").alias("FLAG_DOCUMENT_2"),
            (nat < 18).cast("int").alias("FLAG_DOCUMENT_3"),
            (bal > 3000).cast("int").alias("FLAG_DOCUMENT_5"),
            F.when(nat == 24, "XNA").when(nat < 14, "F").otherwise("M").alias("CODE_GENDER"),
            seg.alias("NAME_EDUCATION_TYPE"), nat.cast("string").alias("ORGANIZATION_TYPE"))

    def bureau(self) -> DataFrame:
        price, prio = F.col("o_totalprice"), F.col("o_orderpriority")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_custkey").alias("SK_ID_CURR"), F.col("o_orderkey").alias("SK_ID_BUREAU"),
            F.when(status == "O", "Active").when(status == "F", "Closed").otherwise("Sold")
            .alias("CREDIT_ACTIVE"),
            F.datediff("o_orderdate", F.to_date(F.lit(PRESENT))).alias("DAYS_CREDIT"),
            F.when(prio == "1-URGENT", 12).otherwise(0).alias("CREDIT_DAY_OVERDUE"),
            F.when(prio == "2-HIGH", 1).otherwise(0).alias("CNT_CREDIT_PROLONG"),
            F.when(prio == "3-MEDIUM", None).otherwise(price / 100).alias("AMT_CREDIT_MAX_OVERDUE"),
            price.alias("AMT_CREDIT_SUM"),
            F.when(status == "P", None).otherwise(price * 0.4 - 20000).alias("AMT_CREDIT_SUM_DEBT"),
            F.when(prio == "1-URGENT", price / 50).otherwise(0.0).alias("AMT_CREDIT_SUM_OVERDUE"),
            F.when(prio == "5-LOW", None).otherwise(price / 24).alias("AMT_ANNUITY"))

    def bbal(self) -> DataFrame:
        qty = F.col("l_quantity")
        days = F.datediff("l_shipdate", F.to_date(F.lit("2001-11-10")))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("SK_ID_BUREAU"),
            F.ceil(days / 30.0).cast("int").alias("MONTHS_BALANCE"),
            F.when(F.col("l_returnflag") == "A", "C").when(qty < 10, "X").when(qty < 30, "0")
            .when(qty < 38, "1").when(qty < 43, "2").when(qty < 46, "3").when(qty < 49, "4")
            .otherwise("5").alias("STATUS"))

    def prev(self) -> DataFrame:
        price, prio = F.col("o_totalprice"), F.col("o_orderpriority")
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
            F.when(status == "F", "Approved").when(status == "O", "Refused")
            .otherwise("Canceled").alias("NAME_CONTRACT_STATUS"),
            F.when(prio == "1-URGENT", "HC").when(prio == "2-HIGH", "LIMIT")
            .when((prio == "3-MEDIUM") & (price > 400000), "FRAUD").otherwise("XAP")
            .alias("CODE_REJECT_REASON"),
            F.when(prio == "4-NOT SPECIFIED", "Auto").when(prio == "5-LOW", "Mobile")
            .otherwise("XNA").alias("NAME_GOODS_CATEGORY"),
            price.alias("AMT_CREDIT"),
            F.when(status == "P", 0.0).otherwise(price * 1.1 - 5000).alias("AMT_APPLICATION"),
            F.when(prio == "5-LOW", None).otherwise(price / 24).alias("AMT_ANNUITY"),
            F.when(prio == "2-HIGH", price / 10).alias("AMT_DOWN_PAYMENT"),
            F.when(prio == "2-HIGH", 0.1).alias("RATE_DOWN_PAYMENT"),
            F.when(prio == "1-URGENT", -999.0).when(prio == "2-HIGH", price / 1000000)
            .alias("RATE_INTEREST_PRIMARY"),
            F.datediff("o_orderdate", F.to_date(F.lit(PRESENT))).alias("DAYS_DECISION"),
            F.when(status != "P", 24.0).alias("CNT_PAYMENT"))

    def inst(self) -> DataFrame:
        paid = F.col("l_quantity") > 1
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("SK_ID_PREV"),
            F.when(paid, F.datediff("l_shipdate", F.to_date(F.lit(PRESENT)))).cast("double")
            .alias("DAYS_ENTRY_PAYMENT"),
            F.col("l_extendedprice").alias("AMT_INSTALMENT"),
            F.when(paid, F.col("l_extendedprice") * (F.col("l_discount") * 3 + 0.85))
            .alias("AMT_PAYMENT"))
        owners = self.raw("orders").select(
            F.col("o_orderkey").alias("SK_ID_PREV"), F.col("o_custkey").alias("SK_ID_CURR"),
            F.datediff("o_orderdate", F.to_date(F.lit(PRESENT))).cast("double")
            .alias("DAYS_INSTALMENT"))
        return lines.join(owners, "SK_ID_PREV")

    def _monthly(self):
        month = F.datediff("ts", F.to_date(F.lit(EVENTS_END))).cast("int")
        return (F.col("user_id").alias("SK_ID_CURR"),
                (F.col("user_id") * 10 + F.col("event_id") % 5).alias("SK_ID_PREV"),
                month.alias("MONTHS_BALANCE"))

    def pos(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return self.raw("events").select(
            *self._monthly(),
            F.when(kind == "signup", None).otherwise(F.floor(value)).cast("double")
            .alias("CNT_INSTALMENT"),
            F.when(kind == "error", F.floor(value)).otherwise(0).cast("int").alias("SK_DPD"),
            F.when(kind == "error", 1).otherwise(0).alias("SK_DPD_DEF"),
            F.when(kind == "view", "Active").when(kind == "purchase", "Completed")
            .otherwise("Signed").alias("NAME_CONTRACT_STATUS"))

    def cc(self) -> DataFrame:
        kind, value = F.col("event_type"), F.col("value")
        return self.raw("events").select(
            *self._monthly(),
            F.when(kind == "signup", None).otherwise(value).alias("AMT_BALANCE"),
            F.when(kind == "click", 0.0).otherwise(120.0).alias("AMT_CREDIT_LIMIT_ACTUAL"),
            F.when(kind == "purchase", value).otherwise(0.0).alias("AMT_DRAWINGS_ATM_CURRENT"),
            F.when(kind == "view", None).otherwise(value / 2).alias("AMT_DRAWINGS_CURRENT"),
            F.when(kind == "error", 0.0).otherwise(10.0).alias("AMT_INST_MIN_REGULARITY"),
            (value / 4).alias("AMT_PAYMENT_CURRENT"),
            F.when(kind == "error", F.floor(value)).otherwise(0).cast("int").alias("SK_DPD"))

    def tables(self) -> dict[str, DataFrame]:
        return {"application": self.applicants(), "bureau": self.bureau(),
                "bureau_balance": self.bbal(), "previous_application": self.prev(),
                "pos_cash": self.pos(), "installments": self.inst(), "credit_card": self.cc()}

    def scored(self) -> DataFrame:
        """Line items as scored rows: (row keys, label, fold, three scores with ties)."""
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        disc = F.col("l_discount")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("fold"),
            F.col("l_shipdate").alias("shipped"), F.col("l_returnflag").alias("flag"),
            (price * (1 - disc) > 60000).cast("int").alias("label"),
            F.round(qty / 51 + 1e-9, 2).alias("score_a"),
            F.round(F.least(price / 110000, F.lit(1.0)) + 1e-9, 3).alias("score_b"),
            F.round(disc * 8 + F.col("l_tax") + 1e-9, 2).alias("score_c"))

    def scored_long(self) -> DataFrame:
        return self.scored().select("id", "fold", "label", "score_a", "score_b", "score_c").unpivot(
            ["id", "fold", "label"], ["score_a", "score_b", "score_c"], "model", "score")


SQL = {
    "app": """SELECT c_custkey AS SK_ID_CURR, CAST(c_acctbal < 0 AS INT) AS TARGET,
      CASE WHEN c_acctbal > 9900 THEN 0.0 WHEN c_mktsegment = 'MACHINERY' AND c_nationkey < 4
           THEN NULL ELSE abs(c_acctbal) * 10 END AS AMT_INCOME_TOTAL,
      (c_acctbal + 1000) * 25 AS AMT_CREDIT,
      CASE WHEN c_nationkey <> 7 THEN (c_acctbal + 1000) * 25 / (12 + c_nationkey) END AS AMT_ANNUITY,
      CASE WHEN c_mktsegment <> 'FURNITURE' THEN (c_acctbal + 1000) * 25 * 0.9::DOUBLE END AS AMT_GOODS_PRICE,
      CAST(-7000 - c_custkey * 131 % 18000 AS INT) AS DAYS_BIRTH,
      CAST(CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 8 THEN 365243
           ELSE -(c_custkey * 97 % 9000) END AS INT) AS DAYS_EMPLOYED,
      CASE WHEN c_mktsegment <> 'BUILDING' THEN (c_custkey * 7919 % 10007) / 10007.0::DOUBLE END AS EXT_SOURCE_1,
      CASE WHEN c_nationkey >= 3 THEN (c_nationkey + 1) / 30.0::DOUBLE END AS EXT_SOURCE_2,
      CASE WHEN NOT (c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 5000) THEN abs(c_acctbal) / 10000 END AS EXT_SOURCE_3,
      CAST(c_mktsegment = 'BUILDING' AS INT) AS FLAG_DOCUMENT_2,
      CAST(c_nationkey < 18 AS INT) AS FLAG_DOCUMENT_3, CAST(c_acctbal > 3000 AS INT) AS FLAG_DOCUMENT_5,
      CASE WHEN c_nationkey = 24 THEN 'XNA' WHEN c_nationkey < 14 THEN 'F' ELSE 'M' END AS CODE_GENDER,
      c_mktsegment AS NAME_EDUCATION_TYPE, CAST(c_nationkey AS VARCHAR) AS ORGANIZATION_TYPE
      FROM customer""",
    "bureau": """SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
      CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
      date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS DAYS_CREDIT,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 12 ELSE 0 END AS CREDIT_DAY_OVERDUE,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS CNT_CREDIT_PROLONG,
      CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_totalprice / 100 END AS AMT_CREDIT_MAX_OVERDUE,
      o_totalprice AS AMT_CREDIT_SUM,
      CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.4::DOUBLE - 20000 END AS AMT_CREDIT_SUM_DEBT,
      CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 50 ELSE 0.0 END AS AMT_CREDIT_SUM_OVERDUE,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 24 END AS AMT_ANNUITY
      FROM orders""",
    "bbal": """SELECT l_orderkey AS SK_ID_BUREAU,
      CAST(ceil(date_diff('day', DATE '2001-11-10', CAST(l_shipdate AS DATE)) / 30.0::DOUBLE) AS INT) AS MONTHS_BALANCE,
      CASE WHEN l_returnflag = 'A' THEN 'C' WHEN l_quantity < 10 THEN 'X' WHEN l_quantity < 30 THEN '0'
           WHEN l_quantity < 38 THEN '1' WHEN l_quantity < 43 THEN '2' WHEN l_quantity < 46 THEN '3'
           WHEN l_quantity < 49 THEN '4' ELSE '5' END AS STATUS
      FROM lineitem""",
    "obal": """SELECT b.*, o.SK_ID_CURR FROM bbal b
      JOIN (SELECT DISTINCT SK_ID_BUREAU, SK_ID_CURR FROM bureau) o USING (SK_ID_BUREAU)""",
    "prev": """SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
      CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'HC' WHEN o_orderpriority = '2-HIGH' THEN 'LIMIT'
           WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 400000 THEN 'FRAUD' ELSE 'XAP' END AS CODE_REJECT_REASON,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Auto' WHEN o_orderpriority = '5-LOW' THEN 'Mobile'
           ELSE 'XNA' END AS NAME_GOODS_CATEGORY,
      o_totalprice AS AMT_CREDIT,
      CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice * 1.1::DOUBLE - 5000 END AS AMT_APPLICATION,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 24 END AS AMT_ANNUITY,
      CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice / 10 END AS AMT_DOWN_PAYMENT,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 0.1::DOUBLE END AS RATE_DOWN_PAYMENT,
      CASE WHEN o_orderpriority = '1-URGENT' THEN -999.0
           WHEN o_orderpriority = '2-HIGH' THEN o_totalprice / 1000000 END AS RATE_INTEREST_PRIMARY,
      date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS DAYS_DECISION,
      CASE WHEN o_orderstatus <> 'P' THEN 24.0::DOUBLE END AS CNT_PAYMENT
      FROM orders""",
    "inst": """SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV,
      CAST(date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS DOUBLE) AS DAYS_INSTALMENT,
      CASE WHEN l_quantity > 1 THEN CAST(date_diff('day', DATE '2001-08-02', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
      l_extendedprice AS AMT_INSTALMENT,
      CASE WHEN l_quantity > 1 THEN l_extendedprice * (l_discount * 3 + 0.85::DOUBLE) END AS AMT_PAYMENT
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "pos": """SELECT user_id AS SK_ID_CURR, user_id * 10 + event_id % 5 AS SK_ID_PREV,
      CAST(date_diff('day', DATE '2024-01-30', CAST(ts AS DATE)) AS INT) AS MONTHS_BALANCE,
      CASE WHEN event_type <> 'signup' THEN floor(value) END AS CNT_INSTALMENT,
      CAST(CASE WHEN event_type = 'error' THEN floor(value) ELSE 0 END AS INT) AS SK_DPD,
      CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS SK_DPD_DEF,
      CASE event_type WHEN 'view' THEN 'Active' WHEN 'purchase' THEN 'Completed' ELSE 'Signed' END AS NAME_CONTRACT_STATUS
      FROM events""",
    "cc": """SELECT user_id AS SK_ID_CURR, user_id * 10 + event_id % 5 AS SK_ID_PREV,
      CAST(date_diff('day', DATE '2024-01-30', CAST(ts AS DATE)) AS INT) AS MONTHS_BALANCE,
      CASE WHEN event_type <> 'signup' THEN value END AS AMT_BALANCE,
      CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 120.0::DOUBLE END AS AMT_CREDIT_LIMIT_ACTUAL,
      CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS AMT_DRAWINGS_ATM_CURRENT,
      CASE WHEN event_type <> 'view' THEN value / 2 END AS AMT_DRAWINGS_CURRENT,
      CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END AS AMT_INST_MIN_REGULARITY,
      value / 4 AS AMT_PAYMENT_CURRENT,
      CAST(CASE WHEN event_type = 'error' THEN floor(value) ELSE 0 END AS INT) AS SK_DPD
      FROM events""",
    "scored": """SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS fold, l_shipdate AS shipped,
      l_returnflag AS flag, CAST(l_extendedprice * (1 - l_discount) > 60000 AS INT) AS label,
      round(l_quantity / 51 + 1e-9, 2) AS score_a, round(least(l_extendedprice / 110000, 1.0) + 1e-9, 3) AS score_b,
      round(l_discount * 8 + l_tax + 1e-9, 2) AS score_c
      FROM lineitem""",
    "slong": """SELECT id, fold, label, 'score_a' AS model, score_a AS score FROM scored
      UNION ALL SELECT id, fold, label, 'score_b', score_b FROM scored
      UNION ALL SELECT id, fold, label, 'score_c', score_c FROM scored""",
}
_NEEDS = {"obal": ["bbal", "bureau"], "slong": ["scored"]}


def with_views(names: str, query: str, **ctes: str) -> str:
    """``WITH`` clause of the named views and extra CTEs, followed by the query."""
    order: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query


def rounded(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded to 6 digits for comparison; a rounded -0.0 becomes 0.0.

    ``nudge`` moves values that end exactly in a half off it, where the last bit of a
    sum would decide the direction.
    """
    return df.select(*[(F.round(F.col(f"`{c}`") + nudge, 6) + 0.0).alias(c) if t == "double"
                       else F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "tinyint")
                       else F.col(f"`{c}`") for c, t in df.dtypes])


NUDGE = 1e-9


def nudge_of(sql: str | None) -> float:
    """Round the Spark side as its SQL does: :func:`sql_rounded` nudges, plain SQL does not."""
    return NUDGE if sql is not None and str(NUDGE) in sql else 0.0


def sql_rounded(query: str, doubles: str = "", longs: str = "", others: str = "") -> str:
    """The SQL counterpart of :func:`rounded` with the nudge."""
    items = others.split() + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [
        f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(items)} FROM ({query})"

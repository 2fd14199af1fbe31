"""The seven-table loan schema: files, column types, relations and fixed name lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KEY = "SK_ID_CURR"
TARGET = "TARGET"

# Source file names.
APPLICATION_FILES = {"train": "application_train", "test": "application_test"}
CHILD_FILES = {
    "bureau": "bureau",
    "bureau_balance": "bureau_balance",
    "previous_application": "previous_application",
    "pos_cash": "POS_CASH_balance",
    "installments": "installments_payments",
    "credit_card": "credit_card_balance",
}

# Text columns of the application table.
APPLICATION_CATEGORICALS = [
    "NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
    "NAME_TYPE_SUITE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS",
    "NAME_HOUSING_TYPE", "OCCUPATION_TYPE", "WEEKDAY_APPR_PROCESS_START",
    "ORGANIZATION_TYPE", "FONDKAPREMONT_MODE", "HOUSETYPE_MODE", "WALLSMATERIAL_MODE",
    "EMERGENCYSTATE_MODE",
]

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "string": T.StringType()}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind])
                         for kind, names in columns.items() for name in names.split()])


def column_type(name: str) -> T.DataType:
    """Type of an application column, by naming convention."""
    if name == KEY or name.startswith("SK_ID"):
        return T.LongType()
    if name in APPLICATION_CATEGORICALS or name.startswith(("NAME_", "CODE_")):
        return T.StringType()
    if name == TARGET or name.startswith(("FLAG_", "CNT_CHILDREN", "REG_", "LIVE_", "HOUR_",
                                          "REGION_RATING")):
        return T.IntegerType()
    if name in ("DAYS_BIRTH", "DAYS_EMPLOYED", "DAYS_ID_PUBLISH"):
        return T.IntegerType()
    return T.DoubleType()


# Beginnings of the names of numeric child columns.
QUANTITIES = ("AMT_", "CNT_", "DAYS_", "HOUR_", "MONTHS_", "NFLAG_", "NUM_", "RATE_", "SELLERPLACE_",
              "SK_DPD", "SK_ID_")


def child_type(table: str, name: str) -> T.DataType:
    """Declared type of a child column, else a number or text as its name tells."""
    declared = {f.name: f.dataType for f in CHILD_SCHEMAS.get(table, T.StructType())}
    return declared.get(name, T.DoubleType() if name.startswith(QUANTITIES) else T.StringType())


CHILD_SCHEMAS = {
    "bureau": _struct(
        long="SK_ID_CURR SK_ID_BUREAU",
        string="CREDIT_ACTIVE CREDIT_CURRENCY CREDIT_TYPE",
        int="DAYS_CREDIT CREDIT_DAY_OVERDUE CNT_CREDIT_PROLONG DAYS_CREDIT_UPDATE",
        double="DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT AMT_CREDIT_MAX_OVERDUE AMT_CREDIT_SUM "
               "AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE AMT_ANNUITY"),
    "bureau_balance": _struct(long="SK_ID_BUREAU", int="MONTHS_BALANCE", string="STATUS"),
    "previous_application": _struct(
        long="SK_ID_PREV SK_ID_CURR",
        string="NAME_CONTRACT_STATUS CODE_REJECT_REASON NAME_GOODS_CATEGORY",
        int="DAYS_DECISION",
        double="AMT_APPLICATION AMT_CREDIT AMT_ANNUITY AMT_DOWN_PAYMENT RATE_DOWN_PAYMENT "
               "RATE_INTEREST_PRIMARY CNT_PAYMENT"),
    "pos_cash": _struct(
        long="SK_ID_PREV SK_ID_CURR", int="MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        double="CNT_INSTALMENT CNT_INSTALMENT_FUTURE", string="NAME_CONTRACT_STATUS"),
    "installments": _struct(
        long="SK_ID_PREV SK_ID_CURR", int="NUM_INSTALMENT_NUMBER",
        double="NUM_INSTALMENT_VERSION DAYS_INSTALMENT DAYS_ENTRY_PAYMENT AMT_INSTALMENT "
               "AMT_PAYMENT"),
    "credit_card": _struct(
        long="SK_ID_PREV SK_ID_CURR", int="MONTHS_BALANCE SK_DPD SK_DPD_DEF",
        double="AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_DRAWINGS_ATM_CURRENT "
               "AMT_DRAWINGS_CURRENT AMT_INST_MIN_REGULARITY AMT_PAYMENT_CURRENT",
        string="NAME_CONTRACT_STATUS"),
}


@dataclass(frozen=True)
class Relation:
    """A parent row has many child rows that carry the parent's key."""

    parent: str
    child: str
    key: str


RELATIONS = [
    Relation("application", "bureau", "SK_ID_CURR"),
    Relation("bureau", "bureau_balance", "SK_ID_BUREAU"),
    Relation("application", "previous_application", "SK_ID_CURR"),
    Relation("application", "pos_cash", "SK_ID_CURR"),
    Relation("previous_application", "pos_cash", "SK_ID_PREV"),
    Relation("application", "installments", "SK_ID_CURR"),
    Relation("previous_application", "installments", "SK_ID_PREV"),
    Relation("application", "credit_card", "SK_ID_CURR"),
    Relation("previous_application", "credit_card", "SK_ID_PREV"),
]

# Prefixes of child-table aggregates, and the counts that mean 0 when absent.
CHILD_PREFIXES = ("bureau_", "bbal_", "prev_", "pos_", "inst_", "cc_")
COUNT_COLUMNS = {
    "bureau_cnt", "bureau_active_cnt", "bureau_closed_cnt", "bureau_overdue_cnt",
    "bureau_prolong_sum", "bureau_has_bbal",
    "prev_cnt", "prev_approved_cnt", "prev_refused_cnt", "prev_cancelled_cnt",
    "pos_cnt", "pos_overdue_cnt",
    "inst_cnt", "inst_late_cnt",
    "cc_cnt", "cc_has_records",
}

# Columns a model must not use for regulatory reasons.
REGULATED = ["CODE_GENDER", "thin_file_young"]
REGULATED_STRICT = ["AGE_YEARS", "EMPLOYED_TO_AGE_RATIO", "CNT_CHILDREN", "CNT_FAM_MEMBERS"]

# Features kept regardless of variance and correlation filters.
PROTECTED = [
    "inst_late_rate_12m", "inst_late_rate_recent_vs_historical", "inst_rolling_30dpd_ratio_3m",
    "inst_delinquency_escalation_flag", "inst_days_since_last_30dpd",
    "bureau_dpd_trend_3m_vs_12m", "bureau_debt_to_new_credit",
    "ANNUITY_INCOME_RATIO", "EMPLOYED_TO_AGE_RATIO", "EXT_SOURCE_NUM_AVAILABLE",
    "bbal_ever_30dpd", "bbal_ever_60dpd", "bbal_ever_90dpd", "bbal_pct_current",
    "bbal_dpd_escalation", "bbal_improving_flag", "inst_late_payment_acceleration",
    "inst_payment_consistency_score", "inst_recency_weighted_dpd", "cc_balance_velocity_3m",
    "cc_utilization_trend", "prev_reject_fraud_flag", "current_to_bureau_debt_ratio",
]


# Child columns that look past the application date, at any depth.
LEAKY_SOURCES = {("credit_card", "SK_DPD"), ("credit_card", "SK_DPD_DEF"),
                 ("pos_cash", "SK_DPD"), ("pos_cash", "SK_DPD_DEF")}


def leaky_columns() -> list[str]:
    """Deny-list: aggregates that look past the application date."""
    # Aggregate names, then every SUM/MEAN/STD of the two DPD columns.
    named = [
        "pos_sk_dpd_max", "pos_sk_dpd_std", "pos_sk_dpd_mean", "pos_sk_dpd_def_max",
        "cc_sk_dpd_max", "cc_sk_dpd_mean", "cc_dpd_rate",
        "bureau_bbal_dpd_rate_mean", "bureau_bbal_dpd_rate_std_mean",
        "bureau_bbal_dpd_rate_6m_mean", "bureau_bbal_dpd_trend_mean",
        "bbal_months_since_last_dpd", "bbal_dpd_last_3m_rate",
        "bbal_dpd_last_6m_vs_prior_rate", "multi_dpd_flag", "dpd_escalation",
    ]
    paths = ["credit_card", "pos_cash", "previous_application.credit_card",
             "previous_application.pos_cash"]
    return named + [f"{fn}({path}.{column})" for path in paths
                    for fn in ("SUM", "MEAN", "STD") for column in ("SK_DPD", "SK_DPD_DEF")]

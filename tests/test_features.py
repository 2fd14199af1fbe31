"""Row-wise features and histories on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe import session
from riskframe.functions import application as app
from riskframe.functions import exprs
from riskframe.operators import history
from riskframe.plans import training
from riskframe.sources.schema import CHILD_SCHEMAS, leaky_columns


def row(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first().asDict()


# ---- missing-value rules --------------------------------------------------------------

def test_helpers_treat_null_as_unknown(spark):
    df = spark.createDataFrame([(None, 2.0), (4.0, 0.0), (4.0, None), (4.0, 2.0)], "n double, d double")
    got = [r[0] for r in df.select(exprs.ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [-999.0, 0.0, 0.0, 2.0]
    assert [r[0] for r in df.select(exprs.flag(F.col("n") > 1)).collect()] == [0.0, 1.0, 1.0, 1.0]
    assert [r[0] for r in df.select(exprs.clip(F.col("d"), 0.5, 1.0)).collect()] == [1.0, 0.5, None, 1.0]


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r[0] for r in exprs.nan_to_null(df).collect()][0] is None
    assert [r[0] for r in exprs.null_to_sentinel(df).collect()] == [-999.0, -999.0, 1.0]


# ---- applications ---------------------------------------------------------------------

COLUMNS = ("SK_ID_CURR long, AMT_CREDIT double, AMT_INCOME_TOTAL double, AMT_ANNUITY double, "
           "AMT_GOODS_PRICE double, DAYS_BIRTH int, DAYS_EMPLOYED int, EXT_SOURCE_1 double, "
           "EXT_SOURCE_2 double, EXT_SOURCE_3 double, FLAG_DOCUMENT_2 int, FLAG_DOCUMENT_3 int")


@pytest.fixture(scope="module")
def applications(spark):
    rows = [
        (1, 400.0, 100.0, 20.0, 360.0, -14610, -1461, 0.2, 0.4, 0.9, 1, 0),   # plain
        (2, 400.0, 100.0, 20.0, 360.0, -14610, 365243, 0.2, None, 0.6, 0, 1),  # unemployed
        (3, 400.0, 0.0, 0.0, None, -14610, -10, None, None, None, 0, 0),      # zero income, no score
        (4, 0.0, 100.0, 20.0, 10.0, -14610, None, 0.5, 0.0, None, 0, 1),      # zero credit
    ]
    return app.application_features(spark.createDataFrame(rows, COLUMNS)).cache()


def test_ratios(applications):
    r = row(applications, SK_ID_CURR=1)
    assert (r["CREDIT_INCOME_RATIO"], r["CREDIT_TERM"], r["GOODS_CREDIT_RATIO"]) == (4.0, 20.0, 0.9)
    assert r["payment_rate"] == pytest.approx(0.05)
    z = row(applications, SK_ID_CURR=3)
    assert z["CREDIT_INCOME_RATIO"] == 0.0 and z["CREDIT_TERM"] == 0.0
    assert z["GOODS_CREDIT_RATIO"] == -999.0
    assert row(applications, SK_ID_CURR=4)["GOODS_CREDIT_RATIO"] == 0.0


def test_age_and_tenure(applications):
    assert row(applications, SK_ID_CURR=1)["AGE_YEARS"] == pytest.approx(40.0)
    assert row(applications, SK_ID_CURR=1)["EMPLOYED_TO_AGE_RATIO"] == pytest.approx(0.1)
    assert row(applications, SK_ID_CURR=2)["YEARS_EMPLOYED"] == 0.0
    assert row(applications, SK_ID_CURR=4)["YEARS_EMPLOYED"] == -999.0
    assert "DAYS_BIRTH" not in applications.columns


def test_scores(applications):
    r = row(applications, SK_ID_CURR=1)
    assert r["EXT_SOURCE_MEAN"] == pytest.approx(0.5) and r["EXT_SOURCE_MEDIAN"] == 0.4
    assert r["EXT_SOURCE_STD"] == pytest.approx(math.sqrt((0.09 + 0.01 + 0.16) / 3))
    assert r["ext_source_prod"] == pytest.approx(0.072)
    two = row(applications, SK_ID_CURR=2)
    assert two["EXT_SOURCE_MEDIAN"] == pytest.approx(0.4) and two["EXT_SOURCE_NUM_AVAILABLE"] == 2
    assert two["EXT_SOURCE_PROD_12"] == -999.0 and two["EXT_SOURCE_2_missing"] == 1.0
    none = row(applications, SK_ID_CURR=3)
    assert none["EXT_SOURCE_MEAN"] == -999.0 and none["ext_source_missing_count"] == 3.0
    assert row(applications, SK_ID_CURR=4)["EXT_SOURCE_RATIO_12"] == 0.0


def test_documents(applications):
    assert row(applications, SK_ID_CURR=1)["DOCUMENTS_SUBMITTED"] == 1
    assert row(applications, SK_ID_CURR=1)["HIGH_RISK_DOC_MISSING"] == 1
    assert row(applications, SK_ID_CURR=2)["HIGH_RISK_DOC_MISSING"] == 0


def test_secondary_features_skip_absent_inputs(spark):
    df = spark.createDataFrame([(1, 0, 0)], "SK_ID_CURR long, prev_cnt int, prev_approved_cnt int")
    out = app.secondary_features(df)
    assert row(out)["prev_approval_rate"] == 0.0 and row(out)["no_prev_applications"] == 1
    assert "bureau_debt_ratio" not in out.columns and "multi_dpd_flag" not in out.columns


def test_fallback_rules(spark):
    df = spark.createDataFrame([(0.5, 3.0, 100.0, 9.0)],
                               "bureau_overdue_rate double, inst_days_past_due_mean double, "
                               "AMT_INCOME_TOTAL double, AMT_ANNUITY double")
    out = row(app.interactions(df))
    assert out["multi_dpd_flag"] == 1.0 and out["debt_service_coverage"] == 10.0


def test_labels_and_bands(spark):
    df = spark.createDataFrame([("bureau_overdue_flag", 0.05), ("EXT_SOURCE_1", 0.5)], "n string, p double")
    got = [tuple(r) for r in df.select(app.column_label(F.col("n")), app.risk_band(F.col("p"))).collect()]
    assert got == [("Bureau: Overdue Flag", "LOW"), ("Ext Source 1", "VERY_HIGH")]


def test_drops(spark):
    df = spark.createDataFrame([(1, "F", 1, 2, 3)],
                               "SK_ID_CURR long, CODE_GENDER string, cc_dpd_rate int, a_x int, a_y int")
    assert "CODE_GENDER" not in app.drop_regulated(df).columns
    assert "cc_dpd_rate" not in app.drop_columns(df, leaky_columns()).columns
    assert app.repair_suffixes(df).columns == ["SK_ID_CURR", "CODE_GENDER", "cc_dpd_rate", "a"]
    report = row(app.drop_report(df, app.drop_regulated(df)))
    assert report["dropped_columns"] == ["CODE_GENDER"] and report["lost_keys"] == 0
    assert len(leaky_columns()) == 40


# ---- histories ------------------------------------------------------------------------

def instalments(spark, rows):
    return spark.createDataFrame(
        rows, "SK_ID_CURR long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, "
              "AMT_INSTALMENT double, AMT_PAYMENT double")


def test_streaks_stay_within_applicants(spark):
    # 1: late, late, on time, late; 2: starts late; a shared counter would join the runs
    rows = [(1, -120.0, -110.0, 10.0, 10.0), (1, -90.0, -80.0, 10.0, 10.0),
            (1, -60.0, -61.0, 10.0, 10.0), (1, -30.0, -29.0, 10.0, 10.0),
            (2, -90.0, -80.0, 10.0, 10.0), (2, -60.0, -50.0, 10.0, 10.0),
            (2, -30.0, -20.0, 10.0, 10.0), (3, -30.0, None, 10.0, None)]
    out = history.instalment_sequences(instalments(spark, rows))
    got = {r["SK_ID_CURR"]: r for r in out.collect()}
    assert [got[k]["inst_max_consec_late_streak"] for k in (1, 2, 3)] == [2, 3, 0]
    assert got[1]["inst_months_since_last_late"] == 1.0
    assert got[3]["inst_months_since_last_late"] is None
    assert got[3]["inst_months_since_last_dpd"] == 999.0


def test_sequences_equal_a_walk_through_the_rows(spark):
    rng = np.random.default_rng(4)
    # applicant 0 has a third of all rows on one day, the NULL applicant has some; days and amounts tie
    rows = [(0, -50.0, float(rng.integers(-60, -40)), float(rng.integers(1, 9)), float(rng.integers(1, 9)))
            for _ in range(300)]
    rows += [(None if k == 7 else int(k), float(d), None if rng.random() < 0.05 and k % 2 else float(d + rng.integers(-3, 4)),
              float(rng.integers(1, 5)), float(rng.integers(1, 5)))
             for k, d in zip(rng.integers(1, 30, 600), rng.integers(-90, 0, 600))]
    df = instalments(spark, rows)
    got = {r["SK_ID_CURR"]: r.asDict() for r in history.instalment_sequences(df).collect()}
    slopes = {r["SK_ID_CURR"]: r[1] for r in history.payment_slope(df).collect()}
    applicants = {r[0] for r in rows}
    assert set(got) == set(slopes) == applicants
    first = lambda x: (x is not None, x or 0.0)  # noqa: E731  (NULL sorts first)
    for key in applicants:
        own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: [first(x) for x in r])
        late = [None if e is None else max(e - d, 0.0) for d, e, _, _ in own]
        run = best = 0
        for x in late:
            run = run + 1 if x else 0
            best = max(best, run)
        seq = np.arange(1, len(own) + 1)
        mean = lambda v: np.mean(v) if len(v) else None
        recent = mean([x for x in late[-12:] if x is not None])
        want = {"inst_max_consec_late_streak": best, "inst_recent_late_mean": recent or 0.0,
                "inst_recent_underpay": np.mean([o - p for _, _, o, p in own][-12:])}
        if len(own) > 1:
            want["inst_payment_amt_slope"] = np.polyfit(seq, [o for _, _, o, _ in own], 1)[0]
            want["inst_payment_ratio_trend"] = np.polyfit(seq, [p / (o + 1e-6) for _, _, o, p in own], 1)[0]
        if None not in late:
            want["inst_recent_vs_historical_dpd"] = np.mean(late[-6:]) / (np.mean(late) + 1e-6)
            want["inst_late_trend"] = np.mean(late[-12:]) - np.mean(late)
        for name, value in want.items():
            assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)
        paid = sorted(own, key=lambda r: (1e9 if r[1] is None else r[1], r[0], r[2], r[3]))
        trend = np.polyfit(seq, [p for _, _, _, p in paid], 1)[0] if len(own) > 2 else 0.0
        assert slopes[key] == pytest.approx(trend, abs=1e-9)


def test_slopes(spark):
    rows = [(1, float(-100 + i), float(-100 + i), 10.0 + 2 * i, 10.0 + 3 * i) for i in range(5)]
    rows += [(2, -10.0, -10.0, 5.0, 5.0)]
    df = instalments(spark, rows)
    seq = {r["SK_ID_CURR"]: r for r in history.payment_sequence(df).collect()}
    assert seq[1]["inst_payment_amt_slope"] == pytest.approx(2.0)
    assert seq[2]["inst_payment_amt_slope"] == 0.0
    slope = {r["SK_ID_CURR"]: r[1] for r in history.payment_slope(df).collect()}
    assert slope[1] == pytest.approx(3.0) and slope[2] == 0.0


def test_late_rates_and_escalation(spark):
    rows = [(1, -10.0, 40.0, 1.0, 1.0), (1, -100.0, -100.0, 1.0, 1.0),   # worse lately
            (2, -100.0, 0.0, 1.0, 1.0),                                   # only the older window
            (3, -500.0, -400.0, 1.0, 1.0), (4, -10.0, None, 1.0, None)]
    got = {r["SK_ID_CURR"]: r for r in history.late_rates(instalments(spark, rows)).collect()}
    assert [got[k]["inst_delinquency_escalation_flag"] for k in (1, 2, 3, 4)] == [1.0, 0.0, -999.0, 1.0]
    assert got[3]["inst_late_rate_12m"] == -999.0 and got[4]["inst_late_rate_12m"] == 0.0
    assert got[1]["inst_late_rate_12m"] == 0.5
    assert got[3]["inst_days_since_last_30dpd"] == 0.0 and got[4]["inst_days_since_last_30dpd"] == -1.0


def test_payment_habits(spark):
    rows = [(1, -60.0, -70.0, 10.0, 13.0), (1, -30.0, -20.0, 10.0, 13.0), (2, -30.0, -40.0, 10.0, 10.0)]
    df = instalments(spark, rows)
    got = {r["SK_ID_CURR"]: r for r in history.payment_habits(df).collect()}
    assert got[1]["inst_early_payment_pct"] == 0.5 and got[1]["inst_large_payment_freq"] == 1.0
    assert got[1]["inst_payment_consistency_score"] == pytest.approx(0.5)
    assert got[2]["inst_payment_consistency_score"] == 0.0
    plain = {r["SK_ID_CURR"]: r for r in history.payment_habits(df, legacy=True).collect()}
    assert plain[1]["inst_recency_weighted_dpd"] == pytest.approx(0.0)
    assert got[1]["inst_recency_weighted_dpd"] == pytest.approx((-10 / 3 + 10 / 2) / (1 / 3 + 1 / 2))


def balances(spark, rows):
    return spark.createDataFrame(rows, "SK_ID_CURR long, SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")


def test_status_profile(spark):
    rows = [(1, 10, 0, "2"), (1, 10, -1, "0"), (1, 11, 0, "C"), (1, 10, -2, "2"), (2, 20, 0, "C")]
    months = balances(spark, rows)
    bureau = months.select("SK_ID_CURR", "SK_ID_BUREAU").distinct()
    bureau = spark.createDataFrame([], CHILD_SCHEMAS["bureau"]).unionByName(
        bureau, allowMissingColumns=True)
    got = {r["SK_ID_CURR"]: r for r in
           history.status_profile(bureau, months.drop("SK_ID_CURR")).collect()}
    assert got[1]["bbal_ever_90dpd"] == 1.0 and got[1]["bbal_ever_60dpd"] == 0.0
    assert got[1]["bbal_dpd_escalation"] == 0.0  # earliest month is already 2
    assert got[1]["bbal_max_dpd_months_ago"] == 0.0 and got[2]["bbal_max_dpd_months_ago"] == -999.0
    assert got[2]["bbal_status_volatility"] == 0.0 and got[2]["bbal_max_status_code"] == -1.0


def test_time_features(spark):
    bbal = balances(spark, [(0, 10, 0, "1"), (0, 10, -1, "0"), (0, 10, -2, "1"), (0, 10, -3, "C"),
                            (0, 10, -4, "1"), (0, 11, 0, "0")]).drop("SK_ID_CURR")
    bureau = spark.createDataFrame([], CHILD_SCHEMAS["bureau"]).unionByName(
        spark.createDataFrame([(1, 10, -730), (1, 11, -731)],
                              "SK_ID_CURR long, SK_ID_BUREAU long, DAYS_CREDIT int"),
        allowMissingColumns=True)
    people = spark.createDataFrame([(1,), (2,)], "SK_ID_CURR long")
    got = {r["SK_ID_CURR"]: r for r in history.time_features(people, bureau, bbal).collect()}
    assert got[1]["bbal_dpd_rate_3m"] == pytest.approx(0.4)
    assert got[1]["bbal_months_since_last_dpd"] == 0.0
    assert got[1]["bbal_months_since_first_dpd"] == 4.0
    assert got[1]["bureau_credit_age_mean"] == pytest.approx(2.0, abs=0.01)
    assert got[2]["bbal_dpd_rate_3m"] == -999.0


def test_loan_windows_share_month_three(spark):
    rows = [(1, 10, -3, "1"), (1, 10, -7, "0")]
    r = row(history.loan_balances(balances(spark, rows)))
    assert r["bbal_dpd_rate_3m"] == 1.0 and r["bbal_dpd_rate_3m_to_12m"] == 0.5
    assert r["bbal_dpd_trend"] == 1.0 and r["bbal_recent_max_severity"] == 1


# ---- training frame -------------------------------------------------------------------

@pytest.fixture(scope="module")
def tables(spark):
    def child(name, rows):
        schema = CHILD_SCHEMAS[name]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return {
        "application": spark.createDataFrame(
            [(1, 0, 100.0, None), (2, 1, 200.0, None), (3, 0, 300.0, 5.0)],
            "SK_ID_CURR long, TARGET int, AMT_CREDIT double, sparse double"),
        "bureau": child("bureau", [
            dict(SK_ID_CURR=1, SK_ID_BUREAU=10, CREDIT_ACTIVE="Active", DAYS_CREDIT=-100,
                 AMT_CREDIT_SUM=50.0, CREDIT_DAY_OVERDUE=0, CNT_CREDIT_PROLONG=0),
            dict(SK_ID_CURR=1, SK_ID_BUREAU=11, CREDIT_ACTIVE="Closed", DAYS_CREDIT=-500,
                 AMT_CREDIT_SUM=150.0, CREDIT_DAY_OVERDUE=3, CNT_CREDIT_PROLONG=1)]),
        "bureau_balance": child("bureau_balance", [
            dict(SK_ID_BUREAU=10, MONTHS_BALANCE=0, STATUS="1"),
            dict(SK_ID_BUREAU=10, MONTHS_BALANCE=-1, STATUS="0"),
            dict(SK_ID_BUREAU=99, MONTHS_BALANCE=0, STATUS="5")]),
        "previous_application": child("previous_application", [
            dict(SK_ID_PREV=5, SK_ID_CURR=2, NAME_CONTRACT_STATUS="Approved", AMT_CREDIT=10.0,
                 AMT_APPLICATION=0.0, DAYS_DECISION=-3)]),
        "pos_cash": child("pos_cash", [dict(SK_ID_PREV=5, SK_ID_CURR=2, MONTHS_BALANCE=0, SK_DPD=0, SK_DPD_DEF=0)]),
        "installments": child("installments", [
            dict(SK_ID_PREV=5, SK_ID_CURR=2, DAYS_INSTALMENT=-10.0, DAYS_ENTRY_PAYMENT=-5.0,
                 AMT_INSTALMENT=4.0, AMT_PAYMENT=2.0)]),
        "credit_card": child("credit_card", [
            dict(SK_ID_PREV=6, SK_ID_CURR=2, MONTHS_BALANCE=-1, AMT_BALANCE=5.0,
                 AMT_CREDIT_LIMIT_ACTUAL=0.0, SK_DPD=0)]),
    }


def test_training_frame(tables):
    out = training.training_frame(tables)
    assert out.count() == 3 and "sparse" not in out.columns
    got = {r["SK_ID_CURR"]: r for r in out.collect()}
    assert got[1]["bureau_cnt"] == 2 and got[2]["bureau_cnt"] == 0
    assert got[1]["bureau_credit_sum"] == 200.0 and got[2]["bureau_credit_sum"] == -999.0
    assert got[1]["bureau_has_bbal"] == 1 and got[3]["bureau_has_bbal"] == 0
    assert got[2]["inst_late_cnt"] == 1 and got[2]["inst_payment_ratio_mean"] == 0.5
    assert got[2]["cc_has_records"] == 1 and got[2]["cc_utilization_mean"] == -999.0
    assert got[2]["prev_credit_to_app_ratio_mean"] == -999.0
    numeric = training.numeric_columns(out)
    assert out.select(*numeric).dropna().count() == 3


def test_training_frame_needs_target(tables):
    with pytest.raises(KeyError):
        training.training_frame({**tables, "application": tables["application"].drop("TARGET")})


def test_last_payments_are_taken_before_the_shuffle(spark):
    """Only the newest rows of an applicant travel for the recent means, not lists of all rows."""
    rows = [(1, float(-d), float(-d + d % 40), 100.0, 90.0) for d in range(300)] + [(None, -5.0, -4.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, "
                                     "AMT_INSTALMENT double, AMT_PAYMENT double")
    out = history.recent_payments(df, 12)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["SK_ID_CURR"]: (r["inst_recent_late_mean"], r["inst_recent_underpay"]) for r in out.collect()}
    assert got[1] == pytest.approx((sum(range(12)) / 12, 10.0)) and got[None] == pytest.approx((1.0, 0.0))


def test_instalment_history_equals_its_parts(spark, monkeypatch):
    """One shuffle gives what the folded summaries give, and applicants with many rows still take those."""
    rng = np.random.default_rng(8)

    def some(value, share=0.1):
        return None if rng.random() < share else float(value)

    rows = [(None if i % 50 == 0 else int(i % 7) if i < 300 else i, some(-rng.integers(0, 30), 0.02),
             some(-rng.integers(0, 30)), some(rng.integers(0, 4) * 10, 0.02), some(rng.integers(0, 4) * 10)) for i in range(420)]
    inst = instalments(spark, rows)
    plain, want = history.instalment_features(inst), history.instalment_sequences(inst)
    parts = plain.join(want, "SK_ID_CURR").join(history.payment_slope(inst), "SK_ID_CURR")
    want = {r["SK_ID_CURR"]: r.asDict() for r in parts.collect()}
    for most in (1_000_000, 20):
        monkeypatch.setattr(history, "GATHERED_ROWS", most)
        out = history.instalment_history(inst)
        got = {r["SK_ID_CURR"]: r.asDict() for r in out.collect()}
        assert got.keys() == want.keys() and len(got) > 100
        for key, r in got.items():
            assert r == pytest.approx({c: want[key][c] for c in r}, abs=1e-9, nan_ok=True), key
    months = balances(spark, [
        (1, i % 5 if i < 90 else i, -(i % 13), "C0123X"[i % 6]) for i in range(120)] + [(1, None, 0, "0")])
    def loans(df):
        return {r["SK_ID_BUREAU"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()}

    want = loans(history.loan_balances(months).where("SK_ID_BUREAU is not null"))
    for most in (1_000_000, 10):
        monkeypatch.setattr(history, "GATHERED_ROWS", most)
        assert loans(history.gathered_balances(months)) == want


def test_frame_shuffles_each_child_once(tables, spark):
    """Rows of a child table travel once or twice, whatever is made of them; spent shuffles leave the disk."""
    plan = training.joined_frame(tables, histories=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 12  # 31 before, on the tables of the driver
    before = spark.conf.get(session.DROP_SHUFFLES)
    session.cut_lineage(tables["bureau"].groupBy("SK_ID_CURR").count(), drop_shuffles=True)
    assert spark.conf.get(session.DROP_SHUFFLES) == before

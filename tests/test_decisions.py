import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.config import DEFAULTS
from tallyfield.operators import decisions


@pytest.fixture(scope="module")
def scores(spark):
    pdf = pd.DataFrame({"customer_id": range(20), "clv_12m": [float(10 * i) for i in range(20)],
                        "p_alive": [0.9 if i % 2 else 0.5 for i in range(20)], "expected_purchases_12m": [2.0] * 20})
    return decisions.with_segments(spark.createDataFrame(pdf)).cache()


@pytest.fixture(scope="module")
def results(spark):
    rows = [(decisions.DID_MODEL, decisions.TOP_COHORT, "weekly_spend_winsor", -2.0, -5.0, 1.0),
            (decisions.DID_MODEL, decisions.TOP_COHORT, "active_last_90d", -0.03, -0.06, 0.0),
            (decisions.DID_MODEL, "Overall (All Treated)", "weekly_spend_winsor", 9.0, 8.0, 10.0)]
    return spark.createDataFrame(rows, "Estimator_Model string, Cohort string, Outcome_Metric string, Estimated_ATT double, "
                                       "ci_lower double, ci_upper double")


def test_segments_and_roi(scores):
    pdf = scores.toPandas()
    cut = pdf["clv_12m"].quantile(0.7)
    assert ((pdf["clv_12m"] >= cut) == pdf["strategy_segment"].str.contains(r"High CLV", regex=False)).all()
    summary = decisions.segment_summary(scores)
    assert summary.agg(F.sum("customer_count")).first()[0] == 20
    roi = decisions.winback_roi(summary, F.lit(3.0)).first()
    seg = pdf[pdf["strategy_segment"] == decisions.SEGMENTS[1]]
    revenue = len(seg) * 0.15 * (seg["clv_12m"].mean() + 12.0)
    assert roi["Targeted_Customers"] == len(seg)
    assert roi["Net_Financial_Impact"] == pytest.approx(revenue * 0.4 - 15.0 * len(seg))
    none_low = decisions.segment_summary(scores.where("p_alive > 0.6"))
    assert decisions.winback_roi(none_low, F.lit(DEFAULTS.fallback_att)).count() == 1


@pytest.mark.parametrize("weeks,used", [(27, 27), (0, 1), (90, 52)])
def test_waiver_formula(results, weeks, used):
    p = decisions.waiver_policy(results, F.lit(100), 0.5, weeks).first()
    assert p["weeks"] == used and p["is_extrapolation"] == (used > 27)
    assert p["net_margin_change_central"] == pytest.approx(0.4 * 0.5 * 100 * used * 2.0)
    assert p["net_margin_change_low"] == pytest.approx(-0.4 * 0.5 * 100 * used * 1.0)
    assert p["net_margin_change_high"] == pytest.approx(0.4 * 0.5 * 100 * used * 5.0)
    assert p["q5_retention_effect"] == pytest.approx(-0.015) and p["q5_retention_effect_worst"] == pytest.approx(-0.03)


def test_curve_and_guardrails(results):
    curve = decisions.sensitivity_curve(results, F.lit(100)).orderBy("waiver_share_pct").collect()
    assert len(curve) == 21 and curve[0]["net_margin_change_central"] == 0.0
    assert all(a["net_margin_change_central"] < b["net_margin_change_central"] for a, b in zip(curve, curve[1:]))
    g = decisions.guardrails(decisions.waiver_policy(results, F.lit(100), 0.5)).first()
    assert g["point_status"] == "AMBER" and g["worst_case_status"] == "RED" and g["band_spans_zero"]
    safe = decisions.guardrails(decisions.waiver_policy(results, F.lit(100), 1.0)).first()
    assert safe["point_status"] == "GREEN"


def test_margin_scenarios(scores):
    zero = decisions.margin_scenario(scores).first()
    assert zero["total_delta_spend"] == 0.0 and zero["total_delta_margin"] == 0.0 and zero["roi_pct"] == 0.0
    lifted = [decisions.margin_scenario(scores, freq_lift=x).first()["total_delta_margin"] for x in (0.05, 0.1, 0.2)]
    assert lifted[0] < lifted[1] < lifted[2]
    one = decisions.margin_scenario(scores, aov_lift=0.1, cost_per_customer=2.0, segment=decisions.SEGMENTS[0]).first()
    hit = scores.where(F.col("strategy_segment") == decisions.SEGMENTS[0]).toPandas()
    assert one["n_targeted"] == len(hit) and one["total_delta_spend"] == pytest.approx(hit["clv_12m"].sum() * 0.1)
    capped = decisions.margin_panel(scores, p_alive_lift=0.3).toPandas()
    assert capped["p_alive_scen"].max() == 1.0

"""Defaults shared by the operators. Every operator also takes these as arguments."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # fixed values: dates
    calibration_end: str = "2010-12-01"
    holdout_end: str = "2011-12-09"
    intervention: str = "2011-06-01"
    cutoffs: tuple[str, ...] = ("2010-12-01", "2011-03-01", "2011-06-01")
    # fixed values: lifetime-value model
    estimation_method: str = "Maximum Likelihood Estimation (MLE)"
    penalizer: float = 0.0
    penalizer_grid: tuple[float, ...] = (0.0, 0.01, 0.1, 1.0)
    discount_rate: float = 0.01
    horizons: tuple[int, ...] = (12, 24)
    days_per_month: float = 30.0
    n_bootstraps: int = 30
    fallback_order_value: float = 350.0
    fallback_f0_rate: float = 0.002465
    # fixed values: policy panel
    treatment_share: float = 0.40
    order_rate_change: float = 0.15
    aov_change: float = 0.10
    churn_scenario: str = "baseline"
    cumulative_churn: float = 0.20
    degraded_churn: float = 0.40
    severe_weekly_hazard: float = 0.20
    shrinkage_weeks: float = 4.0
    fallback_repeat_rate: float = 0.05
    growth_damping: float = 10.0
    winsor_fallback: float = 5000.0
    active_window_weeks: int = 13
    seed: int = 42
    # fixed values: decisions
    cac_per_customer: float = 45.0
    gross_margin: float = 0.40
    campaign_cost: float = 15.0
    winback_rate: float = 0.15
    winback_weeks: float = 4.0
    fallback_att: float = 18.50
    fallback_n_q5: int = 395
    guardrail_amber_pp: float = -0.5
    guardrail_red_pp: float = -2.0

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()

"""Hand-made inputs."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd

RAW_SCHEMA = ("Invoice string, StockCode string, Description string, Quantity int, InvoiceDate timestamp_ntz, Price double, "
              "`Customer ID` bigint, Country string")


def raw_lines(spark):
    """Three customers; a return, a positive-quantity C invoice, a zero price, a missing customer, cutoff-day orders."""
    def t(text):
        return datetime.fromisoformat(text)
    rows = [
        ("1", "A", " mug ", 2, t("2010-01-04T10:00"), 5.0, 1, "United Kingdom"),
        ("1", "B", "cup", 1, t("2010-01-04T10:00"), 4.0, 1, "United Kingdom"),
        ("2", "A", "mug", 3, t("2010-02-01T09:00"), 5.0, 1, "United Kingdom"),
        ("C3", "A", "mug", -1, t("2010-02-03T09:00"), 5.0, 1, "United Kingdom"),
        ("C4", "B", "cup", 2, t("2010-02-04T09:00"), 4.0, 1, "United Kingdom"),   # C prefix, positive quantity
        ("5", "B", "cup", 1, t("2010-03-01T00:00"), 4.0, 2, "France"),             # exactly at the cutoff
        ("6", "B", "cup", 5, t("2010-03-01T00:00:01"), 4.0, 2, "France"),          # one second later
        ("7", "A", "mug", 10, t("2010-03-02T00:00"), 0.0, 2, "France"),            # zero price
        ("8", "A", "mug", 1, t("2010-03-02T00:00"), 5.0, None, "France"),          # no customer
        ("9", "C", "jar", 1, t("2010-03-20T00:00"), 7.0, 3, "Spain"),
        ("9", "C", "jar", 1, t("2010-03-20T00:00"), 7.0, 3, "Spain"),              # identical copy
        ("C10", "C", "jar", -1, t("2010-04-01T00:00"), 7.0, 4, "Spain"),           # returns only
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def panel_frame(spark, n=60, weeks=30, tau=2.0, seed=0, late=False, gaps=False, share=0.4, noise=1.0, t0_week=18):
    """Customer-week panel with a planted effect; optionally late entrants and missing weeks."""
    rng = np.random.default_rng(seed)
    start = date(2011, 1, 3)
    week_effect = rng.normal(0, 3, weeks)
    rows = []
    for i in range(n):
        treated = int(i < n * share)
        level = rng.normal(20, 5)
        first = int(rng.integers(0, t0_week - 2)) if late else 0
        for w in range(first, weeks):
            if gaps and rng.random() < 0.15:
                continue
            post = int(w >= t0_week)
            y = level + week_effect[w] + tau * treated * post + rng.normal(0, noise)
            rows.append((i + 1, start + timedelta(days=7 * w), treated, post, float(y)))
    pdf = pd.DataFrame(rows, columns=["customer_id", "week_date", "is_treated", "is_post_period", "y"])
    df = spark.createDataFrame(pdf, "customer_id bigint, week_date date, is_treated int, is_post_period int, y double")
    return pdf, df, start + timedelta(days=7 * t0_week)


def dummy_regression(pdf, y="y"):
    """Fixed-effects DiD by explicit dummies: estimate, clustered SE (absorbed scaling), cr1 SE."""
    d = (pdf["is_treated"] * pdf["is_post_period"]).to_numpy(float)
    c = pd.get_dummies(pdf["customer_id"]).to_numpy(float)
    w = pd.get_dummies(pdf["week_date"]).to_numpy(float)
    x = np.hstack([c, w])

    def project(v):
        return v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
    dt, yt = project(d), project(pdf[y].to_numpy(float))
    tau = dt @ yt / (dt @ dt)
    score = pd.Series(dt * (yt - tau * dt)).groupby(pdf["customer_id"].to_numpy()).sum()
    n, g, k = len(pdf), c.shape[1], w.shape[1]
    raw = float((score ** 2).sum()) / (dt @ dt) ** 2
    return tau, np.sqrt(raw * n / (n - (g + k - 1) - 1)), np.sqrt(raw * g / (g - 1) * (n - 1) / (n - g - k)), dt

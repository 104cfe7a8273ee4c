"""Forecasts of metric series: every model's errors at every origin, the best model, bands by step and a confidence.

A series is one metric over its calendar and so bounded; each is one group. A model is run once over a series and gives its forecasts from
every point on (a matrix origins x steps), so the whole history is the backtest: the error table has a row for each origin
whose next steps are known. Bands come from the table's columns: a step's band is as wide as errors at that step were.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points a series needs, share of periods that may be missing, confidence from which a forecast is sure, longest horizon.
LEAST, MOST_MISSING, SURE, LONGEST = 20, 0.2, 0.55, 365
#: Normal quantiles of bands of 80 and 95 %.
Z80, Z95 = 1.281552, 1.959964
#: Weights of data quality, error, stability, gain on the baseline and calibration in the confidence.
WEIGHTS = {"quality": 0.4, "error": 0.25, "stability": 0.15, "gain": 0.1, "calibration": 0.1}
_FIELDS = (
    "step int, model string, value double, lower80 double, upper80 double, lower95 double, upper95 double, mase double, wape double, smape double, mae double, origins int, baseline string, "
    "improvement double, coverage80 double, coverage95 double, confidence double, missing_rate double, status string"
)


def _smoothed(y: np.ndarray, steps: np.ndarray, season: int | None) -> np.ndarray:
    """Damped-trend smoothing (with an additive season if there is one) from every origin.

    All settings of a grid run side by side; at each origin the one with the smallest squared one-step errors so far forecasts.
    """
    axes = [(0.1, 0.3, 0.5, 0.7, 0.9), (0.02, 0.1, 0.3), (0.8, 0.9, 0.98), (0.05, 0.2, 0.5) if season else (0.0,)]
    alpha, beta, phi, gamma = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
    size = season or 1
    level = np.full(len(alpha), y[:size].mean() if season else y[0])
    trend = np.zeros(len(alpha)) if season or len(y) < 2 else np.full(len(alpha), y[1] - y[0])
    wave = np.tile(y[:size] - y[:size].mean() if season else np.zeros(1), (len(alpha), 1))
    loss, out = np.zeros(len(alpha)), np.empty((len(y), len(steps)))
    for t, value in enumerate(y):
        slot = t % size
        expected = level + phi * trend
        if t:
            loss += (value - expected - wave[:, slot]) ** 2
            before = level
            level = alpha * (value - wave[:, slot]) + (1 - alpha) * expected
            trend = beta * (level - before) + (1 - beta) * phi * trend
            if season:
                wave[:, slot] += gamma * (value - level - wave[:, slot])
        best = int(np.argmin(loss))
        out[t] = level[best] + trend[best] * np.cumsum(phi[best] ** np.arange(1, steps[-1] + 1))[steps - 1] + wave[best, (t + steps) % size]
    return out


def paths(y: np.ndarray, horizon: int, season: int | None) -> dict[str, np.ndarray]:
    """For each model the forecasts of the next ``horizon`` values from every point on: points x steps, nan where it knows too little."""
    at, steps = np.arange(len(y))[:, None], np.arange(1, horizon + 1)
    out = {
        "naive": np.repeat(y[:, None], horizon, axis=1),
        "drift": y[:, None] + (y[:, None] - y[0]) / np.maximum(at, 1) * steps,
        "holt_damped": _smoothed(y, steps, None),
    }
    if season:
        back = at - season + 1 + (steps - 1) % season
        out["seasonal_naive"] = np.where(back >= 0, y[np.maximum(back, 0)], np.nan)
        out["ets"] = np.where(at >= 2 * season - 1, _smoothed(y, steps, season), np.nan)
    return out


def error_table(y: np.ndarray, path: np.ndarray, first: int) -> np.ndarray:
    """What came less what was forecast: a row for each origin from ``first`` on whose steps are all known."""
    n, h = path.shape
    origins = np.arange(first - 1, n - h)
    return y[origins[:, None] + np.arange(1, h + 1)] - path[origins]


def _measures(errors: np.ndarray, actual: np.ndarray, scale: float) -> dict[str, float]:
    size = np.abs(errors)
    return {
        "mase": float(size.mean() / max(scale, 1e-9)), "wape": float(size.sum() / max(np.abs(actual).sum(), 1e-9)),
        "smape": float((2 * size / np.maximum(np.abs(actual) + np.abs(actual - errors), 1e-9)).mean()), "mae": float(size.mean()),
    }


def best_forecast(y: np.ndarray, horizon: int, season: int | None, quality: float) -> tuple[pd.DataFrame, float]:
    """(rows by step, confidence) of the model with the smallest MASE, then WAPE, over the error tables."""
    season = season if season and len(y) >= 2 * season else None
    h = min(horizon, max(1, min(12, len(y) // 6)))
    first = max(8, 2 * (season or 0))
    if len(y) - h < first:
        first = max(5, len(y) - 2 * h)
    lag = season or 1
    scale = float(np.abs(y[lag:] - y[:-lag]).mean())
    tables = {k: error_table(y, p, first) for k, p in paths(y, h, season).items()}
    tables = {k: e for k, e in tables.items() if len(e) and np.isfinite(e).all()}
    actual = y[np.arange(first - 1, len(y) - h)[:, None] + np.arange(1, h + 1)]
    scores = {k: _measures(e, actual, scale) for k, e in tables.items()}
    model = min(scores, key=lambda k: (scores[k]["mase"], scores[k]["wape"]))
    baseline = "seasonal_naive" if "seasonal_naive" in scores else "naive"
    errors = tables[model]
    # bands never narrow with the step; beyond the backtest they widen with the root of the step
    spread = np.maximum.accumulate(np.sqrt((errors**2).mean(axis=0)))
    step = np.arange(1, horizon + 1)
    wide = np.where(step <= h, spread[np.minimum(step, h) - 1], spread[-1] * np.sqrt(step / h))
    inside = [float((np.abs(errors) <= z * spread).mean()) for z in (Z80, Z95)]
    gain = (scores[baseline]["mase"] - scores[model]["mase"]) / max(scores[baseline]["mase"], 1e-9)
    parts = {
        "quality": quality, "error": 1 / (1 + scores[model]["mase"]), "stability": 1 / (1 + float((np.abs(errors).mean(axis=1) / max(scale, 1e-9)).std())),
        "gain": min(max(0.5 + gain, 0.0), 1.0), "calibration": max(0.0, 1 - (abs(inside[0] - 0.8) + abs(inside[1] - 0.95)) / 1.75),
    }
    sure = min(max(sum(WEIGHTS[k] * v for k, v in parts.items()), 0.0), 1.0)
    value = paths(y, horizon, season)[model][-1]
    rows = pd.DataFrame({"step": step, "value": value, "lower80": value - Z80 * wide, "upper80": value + Z80 * wide, "lower95": value - Z95 * wide, "upper95": value + Z95 * wide})
    return rows.assign(model=model, origins=len(errors), baseline=baseline, improvement=gain, coverage80=inside[0], coverage95=inside[1], **scores[model]), sure


def auto_forecast(df: DataFrame, by: list[str], period: str, value: str, horizon: int, season: int | None = None, least: int = LEAST, most_missing: float = MOST_MISSING, sure: float = SURE) -> DataFrame:
    """(by, step, model, value, bands, error measures, baseline, coverage, confidence, missing_rate, status) of each series' best model.

    Rows with a null value are missing periods. Too few points or too many missing ones: one row of step 0 and status INSUFFICIENT_DATA.
    Otherwise QUALIFIED, or LOW_CONFIDENCE below ``sure``. At most ``LONGEST`` steps.
    """
    horizon = max(1, min(horizon, LONGEST))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        y = pdf[value].dropna().to_numpy(dtype=float)
        missing = 1 - len(y) / len(pdf)
        if len(y) < least or missing > most_missing or not np.isfinite(y).all():
            rows = pd.DataFrame({"step": [0], "status": ["INSUFFICIENT_DATA"]})
        else:
            quality = 0.45 * (1 - missing) + 0.25 * min(1.0, len(y) / (2 * least)) + 0.2 + 0.1 * (1.0 if y.std() > 1e-12 else 0.8)
            rows, confidence = best_forecast(y, horizon, season, quality)
            rows = rows.assign(confidence=confidence, status="QUALIFIED" if confidence >= sure else "LOW_CONFIDENCE")
        rows = rows.assign(missing_rate=missing, **{k: pdf[k].iloc[0] for k in by})
        rows = rows.reindex(columns=[*by, *names])
        return pd.DataFrame({c: pd.Series([None if pd.isna(v) else v for v in rows[c]], dtype=object) for c in rows.columns})

    return df.select(*by, period, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(one, f"{keys}, {_FIELDS}")

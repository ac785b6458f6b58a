"""Score arithmetic as native column expressions."""
from pyspark.sql import functions as F

from headwise.schema import ANOMALY_SCORE, HIGH_ANOMALY_SCORE, RESIDUAL_HISTORY_MIN

# Severity bands (lower bound inclusive), low to critical.
BANDS = [("low", 0.0), ("watch", 0.35), ("elevated", 0.60), ("critical", 0.85)]


def clip01(x):
    """Clamp to [0, 1]; NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def relative_error(residual, predicted):
    """Residual against the predicted headway, with a two-minute floor."""
    return clip01(F.abs(residual) / F.greatest(F.abs(predicted), F.lit(120.0)))


def ssl_residual_score(residual, history_n, q50, q99, ema):
    """Residual calibrated by rolling quantiles, or by the EMA while history is short."""
    size = F.abs(residual)
    by_history = clip01((size - q50) / F.greatest(q99 - q50, F.lit(1.0)))
    by_scale = clip01(size / (F.lit(3.5) * F.greatest(ema, F.lit(1.0))))
    return (
        F.when(size <= 0, F.lit(0.0))
        .when(F.coalesce(history_n, F.lit(0)) >= RESIDUAL_HISTORY_MIN, by_history)
        .otherwise(by_scale)
    )


def composite_score(ssl, trees, relative):
    return clip01(F.lit(0.50) * ssl + F.lit(0.30) * clip01(trees) + F.lit(0.20) * relative)


def severity_flags(score):
    return [
        (score >= ANOMALY_SCORE).alias("is_anomaly"),
        (score >= HIGH_ANOMALY_SCORE).alias("is_high"),
    ]


def clamp_score(score):
    return clip01(F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)))


def severity_band(score):
    clamped = clamp_score(score)
    band = F.lit(BANDS[0][0])
    for name, lower in BANDS[1:]:
        band = F.when(clamped >= lower, F.lit(name)).otherwise(band)
    return band

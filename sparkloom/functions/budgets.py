"""Schedules, token and compute budgets, and penalties, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The small probe model, its schedule, and the penalties of a mixture-law fit.
PARAMETERS = 57_078_144
SEQUENCE = 2048
BATCH = 96
PEAK = 5.8e-3
WARMUP, DECAY, FLOOR = 0.10, 0.10, 0.1
K_RATIO_SOFT = 20.0
RMSE_SLACK = 1.35


def learning_rate(step: Column, total: Column, peak: float = PEAK) -> Column:
    """Linear warm-up, a constant peak, then a cosine to FLOOR of it over the last part of the steps."""
    warm = F.greatest(F.lit(1), F.bround(total * WARMUP))
    fall = F.greatest(warm, total - F.greatest(F.lit(1), F.bround(total * DECAY)))
    low = peak * FLOOR
    wave = low + (peak - low) * (1 + F.cos(math.pi * (step - fall) / (total - fall))) / 2
    return F.when(step < warm, peak * step / warm).when(step < fall, F.lit(peak)).when((step >= total) | (total <= fall), F.lit(low)).otherwise(wave)


def token_budget(ratio: Column, parameters: int = PARAMETERS, sequence: int = SEQUENCE, batch: int = BATCH) -> tuple[Column, Column, Column]:
    """(sequences, steps, tokens) of whole steps at a ratio of tokens to parameters; null where not even one fits."""
    steps = F.floor(F.floor(F.floor(ratio * parameters) / sequence) / batch)
    steps = F.when((ratio > 0) & (steps >= 1), steps.cast("long"))
    return steps * batch, steps, steps * batch * sequence


def gpu_hours(tokens: Column, speed: float = 150_000.0, eval_minutes: float = 12.0) -> Column:
    return (tokens / max(speed, 1.0) + eval_minutes * 60) / 3600


def training_flops(parameters: Column, layers: Column, sequence: Column, width: Column, tokens: Column) -> Column:
    """6 N D and the attention's 12 L s d D, as a double."""
    each = 6 * parameters.cast("double") + 12 * layers.cast("double") * sequence * width
    return each * tokens.cast("double")


def moderation(t: Column, k: Column, spread: Column) -> Column:
    """Lower for small exponents (array t) and a scale k near the spread of the observations."""
    n, total = F.size(t), F.aggregate(t, F.lit(0.0), lambda s, x: s + x * x)
    ratio = k / F.greatest(spread, F.lit(1e-6))
    off = F.abs(F.log10(F.greatest(ratio, F.lit(1e-12)))) + F.when(ratio > K_RATIO_SOFT, F.log10(ratio / K_RATIO_SOFT)).otherwise(0.0)
    return F.sqrt(total / n) + 0.25 * F.array_max(F.transform(t, F.abs)) + 0.5 * off


def relative_error(planned: Column, measured: Column) -> Column:
    """Null where nothing was measured."""
    return F.when(measured != 0, F.abs(planned - measured) / measured)


def log_parameters(c: Column, k: Column, t: Column) -> Column:
    """(ln c, ln k, t...) as one array."""
    return F.concat(F.array(F.ln(c), F.ln(k)), t)

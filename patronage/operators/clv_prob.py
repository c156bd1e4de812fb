"""Probabilistic CLV: BG/NBD and Gamma-Gamma.

Data work stays in Spark: the per-customer summary is two group-bys, the
likelihood of a parameter vector is one ``agg`` (a sum over customers, after
collapsing customers with identical (x, t_x, T) into weighted rows), and
predictions are native column math or Arrow-batched numpy (the hypergeometric
series).  Only the parameter vector (4 or 3 numbers) and scalar likelihood
sums travel between the driver and the executors.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.money import amount
from patronage.functions.ordering import quantile_table
from patronage.functions.special import digamma_np, lgamma, lgamma_np, log_add_exp, scaled_hyp2f1
from patronage.operators.binning import qcut
from patronage.operators.cleaning import spend_of, spend_scale
from patronage.session import materialize


# ------------------------------------------------------------------ summaries (H2-H4)

def _daily(lines: DataFrame) -> DataFrame:
    return lines.groupBy("CustomerID", F.to_date("InvoiceDate").alias("_day")).agg(
        F.sum(spend_of(lines)).alias("_cents"))


def lifetimes_summary(lines: DataFrame, end: Column) -> DataFrame:
    """H2: per customer, with days as periods and ``end`` as observation end:
    frequency = active days - 1, recency = last - first day, T = end day -
    first day, monetary_value = mean daily spend over the repeat days (0 if
    none).  Lines after ``end`` are ignored."""
    daily = _daily(lines.filter(F.col("InvoiceDate") <= end))
    per = daily.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_day").alias("_first"), F.max("_day").alias("_last"),
        F.sum("_cents").alias("_tot"), F.min_by("_cents", "_day").alias("_first_cents"))
    freq = F.col("_n") - 1
    return per.select(
        "CustomerID", freq.cast("long").alias("frequency"),
        F.datediff("_last", "_first").cast("double").alias("recency"),
        F.datediff(F.to_date(end), F.col("_first")).cast("double").alias("T"),
        F.when(freq > 0, amount(F.col("_tot") - F.col("_first_cents"), spend_scale(lines))
               / freq.cast("double")).otherwise(F.lit(0.0)).alias("monetary_value"))


def calibration_holdout(lines: DataFrame, calibration_end: Column, end: Column) -> DataFrame:
    """H3: calibration summary up to ``calibration_end`` plus holdout activity
    in (calibration_end, end]: frequency_holdout (active days),
    monetary_value_holdout (mean daily spend) and duration_holdout (days).
    Customers without a calibration purchase are dropped; no holdout -> 0."""
    cal = lifetimes_summary(lines, calibration_end).select(
        "CustomerID", *[F.col(c).alias(f"{c}_cal") for c in
                        ("frequency", "recency", "T", "monetary_value")])
    hold = _daily(lines.filter((F.col("InvoiceDate") > calibration_end)
                               & (F.col("InvoiceDate") <= end)))
    hold = hold.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("frequency_holdout"),
        (amount(F.sum("_cents"), spend_scale(lines)) / F.count(F.lit(1)).cast("double"))
        .alias("monetary_value_holdout"))
    out = cal.join(hold, "CustomerID", "left")
    return out.select(
        "CustomerID", "frequency_cal", "recency_cal", "T_cal", "monetary_value_cal",
        F.coalesce(F.col("frequency_holdout").cast("double"), F.lit(0.0)).alias("frequency_holdout"),
        F.coalesce(F.col("monetary_value_holdout"), F.lit(0.0)).alias("monetary_value_holdout"),
        F.datediff(F.to_date(end), F.to_date(calibration_end)).cast("double")
        .alias("duration_holdout"))


def repeat_customers(summary: DataFrame) -> DataFrame:
    """H4: frequency > 0 (the published fit excludes one-time buyers)."""
    return summary.filter(F.col("frequency") > 0)


# ------------------------------------------------------------- likelihoods (H5, H6)

def bgnbd_loglik(x: Column, tx: Column, T: Column, r, alpha, a, b) -> Column:
    """Per-customer BG/NBD log-likelihood (Fader, Hardie & Lee 2005)."""
    r, alpha, a, b = (F.lit(float(v)) for v in (r, alpha, a, b))
    xd = x.cast("double")
    a1 = lgamma(r + xd) - lgamma(r) + r * F.log(alpha)
    a2 = lgamma(a + b) + lgamma(b + xd) - lgamma(b) - lgamma(a + b + xd)
    a3 = -(r + xd) * F.log(alpha + T)
    a4 = F.log(a) - F.log(b + F.greatest(xd, F.lit(1.0)) - 1) - (r + xd) * F.log(alpha + tx)
    return a1 + a2 + F.when(x > 0, log_add_exp(a3, a4)).otherwise(a3)


def gamma_gamma_loglik(x: Column, m: Column, p, q, v) -> Column:
    """Per-customer Gamma-Gamma log-likelihood of mean spend m over x repeats."""
    p, q, v = (F.lit(float(t)) for t in (p, q, v))
    px = p * x.cast("double")
    return (lgamma(px + q) - lgamma(px) - lgamma(q) + q * F.log(v) + (px - 1) * F.log(m)
            + px * F.log(x.cast("double")) - (px + q) * F.log(x * m + v))


#: Step lengths that one job of the fit tries at once.
_STEPS = (1.0, 0.5, 0.25, 0.1, 0.01, 1e-4)


def _bfgs(values, x0, max_iter=300, gtol=1e-6, ftol=1e-13, flat=1e-4, max_step=5.0):
    """Quasi-Newton minimiser; ``values(points)`` returns (f, gradient) at many points in ONE Spark job,
    and an iteration is one job: all step lengths, each with its gradient.

    Returns (x, f, iterations, converged): the gradient is below ``gtol``, or below ``flat`` where no step
    lowers f by more than rounding (``ftol``).  Anything else that ends the search is not converged."""
    x = np.asarray(x0, dtype="float64")
    eye = np.eye(x.size)
    f, g = values([x])[0]
    H, it = eye.copy(), 0
    for it in range(max_iter):
        if not np.all(np.isfinite(g)) or not np.isfinite(f):
            return x, f, it, False
        if np.max(np.abs(g)) < gtol:
            return x, f, it, True
        p = -H @ g
        if g @ p >= 0:
            H, p = eye.copy(), -g
        longest = np.max(np.abs(p))
        if longest > max_step:          # log-parameters: at most e^5 per step
            p = p * (max_step / longest)
        tried = zip(_STEPS, values([x + s * p for s in _STEPS]), strict=True)
        chosen = next(((s, fv, gv) for s, (fv, gv) in tried
                       if np.isfinite(fv) and np.all(np.isfinite(gv)) and fv <= f + 1e-4 * s * (g @ p)), None)
        if chosen is None:
            if np.array_equal(H, eye):
                return x, f, it + 1, bool(np.max(np.abs(g)) < flat)
            H = eye.copy()
            continue
        step, f_new, g_new = chosen
        sv, yv = step * p, g_new - g
        sy = sv @ yv
        if sy > 1e-12:
            rho = 1.0 / sy
            H = (eye - rho * np.outer(sv, yv)) @ H @ (eye - rho * np.outer(yv, sv)) \
                + rho * np.outer(sv, sv)
        lowered = f - f_new
        x, f, g = x + sv, f_new, g_new
        if lowered <= ftol * max(1.0, abs(f)) and np.max(np.abs(g)) < flat:
            return x, f, it + 1, True
    return x, f, max_iter, False


@dataclass
class BetaGeoParams:
    r: float
    alpha: float
    a: float
    b: float
    loglik: float = float("nan")
    iterations: int = 0
    converged: bool = True

    def as_tuple(self):
        return (self.r, self.alpha, self.a, self.b)


@dataclass
class GammaGammaParams:
    p: float
    q: float
    v: float
    loglik: float = float("nan")
    iterations: int = 0
    converged: bool = True
    left_out: int = 0

    def as_tuple(self):
        return (self.p, self.q, self.v)


def _compress(df: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse identical likelihood inputs to weighted rows and materialise
    them, so every optimiser step re-reads a small table."""
    return materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w")), "likelihood-input")


def bgnbd_loglik_np(x, tx, T, r, alpha, a, b):
    """numpy twin of ``bgnbd_loglik`` (used inside tasks by the fit)."""
    a1 = lgamma_np(r + x) - lgamma_np(r) + r * np.log(alpha)
    a2 = lgamma_np(a + b) + lgamma_np(b + x) - lgamma_np(b) - lgamma_np(a + b + x)
    a3 = -(r + x) * np.log(alpha + T)
    with np.errstate(divide="ignore", invalid="ignore"):
        a4 = np.log(a) - np.log(b + np.maximum(x, 1.0) - 1.0) - (r + x) * np.log(alpha + tx)
    return a1 + a2 + np.where(x > 0, np.logaddexp(a3, np.where(x > 0, a4, a3)), a3)


def gamma_gamma_loglik_np(x, m, p, q, v):
    px = p * x
    return (lgamma_np(px + q) - lgamma_np(px) - lgamma_np(q) + q * np.log(v)
            + (px - 1.0) * np.log(m) + px * np.log(x) - (px + q) * np.log(x * m + v))


def bgnbd_gradient_np(x, tx, T, r, alpha, a, b):
    """Derivatives of ``bgnbd_loglik_np`` by r, alpha, a and b."""
    repeat = x > 0
    last = b + np.maximum(x, 1.0) - 1.0
    a3 = -(r + x) * np.log(alpha + T)
    a4 = np.log(a) - np.log(last) - (r + x) * np.log(alpha + tx)
    # share of the likelihood of a customer who has left after the last purchase
    gone = np.where(repeat, np.exp(a4 - np.logaddexp(a3, a4)), 0.0)
    stays = 1.0 - gone
    both = digamma_np(a + b) - digamma_np(a + b + x)
    return (digamma_np(r + x) - digamma_np(r) + np.log(alpha)
            - stays * np.log(alpha + T) - gone * np.log(alpha + tx),
            r / alpha - (r + x) * (stays / (alpha + T) + gone / (alpha + tx)),
            both + gone / a,
            both + digamma_np(b + x) - digamma_np(b) - gone / last)


def gamma_gamma_gradient_np(x, m, p, q, v):
    """Derivatives of ``gamma_gamma_loglik_np`` by p, q and v."""
    px, total = p * x, np.log(x * m + v)
    top = digamma_np(px + q)
    return (x * (top - digamma_np(px) + np.log(m) + np.log(x) - total),
            top - digamma_np(q) + np.log(v) - total,
            q / v - (px + q) / (x * m + v))


def _objective(comp, cols, loglik, gradient, n, penalizer, scale_cols=None):
    """``values(points)`` for :func:`_bfgs` over log-parameters: mean negative log-likelihood, with the
    penalty, and its gradient.  Every task evaluates its rows at all points with numpy and returns one row of
    partial sums a point; Spark adds them, so a row a point reaches the driver."""
    scale_cols = scale_cols or {}

    def values(points):
        with np.errstate(over="ignore"):
            at = [np.exp(np.asarray(p, dtype="float64")) for p in points]
        d = at[0].size

        def partial(batches):
            acc = np.zeros((len(at), d + 1))
            for pdf in batches:
                args = [pdf[c].to_numpy(dtype="float64") * scale_cols.get(c, 1.0) for c in cols]
                w = pdf["_w"].to_numpy(dtype="float64")
                with np.errstate(all="ignore"):
                    for k, theta in enumerate(at):
                        acc[k, 0] += np.sum(w * loglik(*args, *theta))
                        acc[k, 1:] += [np.sum(w * part) for part in gradient(*args, *theta)]
            # Arrow turns NaN into NULL, which sums leave out: an undefined likelihood is -inf
            acc[~np.isfinite(acc).all(axis=1)] = -np.inf
            yield pd.DataFrame({"k": np.arange(len(at), dtype="int64"), **{f"s{i}": acc[:, i] for i in range(d + 1)}})

        sums = [f"s{i}" for i in range(d + 1)]
        rows = (comp.select(*cols, "_w").mapInPandas(partial, "k long, " + ", ".join(f"{c} double" for c in sums))
                .groupBy("k").agg(*[F.sum(c).alias(c) for c in sums]).collect())
        out = [(float("inf"), np.full(d, np.nan))] * len(at)
        for row in rows:
            theta, total = at[row["k"]], np.array(row[1:])
            if np.all(np.isfinite(total)):
                with np.errstate(over="ignore"):
                    f = -total[0] / n + penalizer * float(np.sum(theta ** 2))
                    out[row["k"]] = (float(f), -total[1:] * theta / n + 2.0 * penalizer * theta ** 2)
        return out

    return values


def _ended(name: str, iterations: int, converged: bool, raise_error: bool) -> None:
    if converged:
        return
    said = f"the {name} fit has not converged after {iterations} iterations; its parameters are no maximum"
    if raise_error:
        raise RuntimeError(said)
    warnings.warn(said, RuntimeWarning, stacklevel=3)


def bgnbd_fit(summary: DataFrame, include_one_time: bool = False, penalizer: float = 0.0,
              max_iter: int = 300, raise_error: bool = False) -> BetaGeoParams:
    """H5: maximum-likelihood r, alpha, a, b.

    Parity default fits repeat customers only (frequency > 0), as published;
    ``include_one_time=True`` uses every customer (the unbiased fit).  Times
    are scaled by 10 / max(T) during the fit and alpha is scaled back.  A search
    that ends elsewhere than at a maximum warns, or raises with ``raise_error``,
    and ``converged`` says so.  Without customers it raises ``ValueError``.
    """
    data = summary if include_one_time else repeat_customers(summary)
    comp = _compress(data.select("frequency", "recency", "T"), ["frequency", "recency", "T"])
    stats = comp.agg(F.sum("_w").alias("n"), F.max("T").alias("tmax")).first()
    if not stats["n"]:
        raise ValueError("no customers to fit")
    n, tmax = float(stats["n"]), float(stats["tmax"])
    scale = 10.0 / tmax
    values = _objective(comp, ["frequency", "recency", "T"], bgnbd_loglik_np, bgnbd_gradient_np, n, penalizer,
                        {"recency": scale, "T": scale})
    theta, f, iters, converged = _bfgs(values, np.zeros(4), max_iter)
    _ended("BG/NBD", iters, converged, raise_error)
    r, al, a, b = np.exp(theta)
    return BetaGeoParams(float(r), float(al / scale), float(a), float(b), float(-f * n), iters, converged)


def gamma_gamma_fit(summary: DataFrame, penalizer: float = 0.0, max_iter: int = 300,
                    raise_error: bool = False) -> GammaGammaParams:
    """H6: maximum-likelihood p, q, v on repeat customers with positive spend; the likelihood has no value for
    others.  ``left_out`` counts the repeat customers whose spend is not positive (or NULL).  A search that
    ends elsewhere than at a maximum warns or raises as in :func:`bgnbd_fit`."""
    comp = _compress(repeat_customers(summary).select("frequency", "monetary_value"), ["frequency", "monetary_value"])
    fits = F.coalesce(F.col("monetary_value") > 0, F.lit(False))
    stats = comp.agg(F.sum(F.when(fits, F.col("_w"))), F.sum(F.when(~fits, F.col("_w")))).first()
    if not stats[0]:
        raise ValueError("no customers to fit")
    n = float(stats[0])
    values = _objective(comp.where(fits), ["frequency", "monetary_value"], gamma_gamma_loglik_np,
                        gamma_gamma_gradient_np, n, penalizer)
    theta, f, iters, converged = _bfgs(values, np.zeros(3), max_iter)
    _ended("Gamma-Gamma", iters, converged, raise_error)
    p, q, v = np.exp(theta)
    return GammaGammaParams(float(p), float(q), float(v), float(-f * n), iters, converged, int(stats[1] or 0))


def params_frame(spark, params) -> DataFrame:
    """The fitted parameters as a 1-row DataFrame (for reports / sinks)."""
    d = {k: v if isinstance(v, bool) else float(v) for k, v in vars(params).items()}
    return spark.createDataFrame([tuple(d.values())], ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in d.items()))


# ------------------------------------------------------------------ predictions

def expected_purchases_np(t, x, tx, T, r, alpha, a, b):
    """Conditional expected purchases in (T, T+t] (numpy, vectorised)."""
    t, x, tx, T = (np.asarray(v, dtype="float64") for v in (t, x, tx, T))
    if abs(a - 1.0) < 1e-9:          # removable singularity at a = 1
        a = 1.0 + 1e-9
    z = t / (alpha + T + t)
    hyp = scaled_hyp2f1(r + x, b + x, a + b + x - 1.0, z, (r + x) * np.log1p(-z))
    first = (a + b + x - 1.0) / (a - 1.0)
    num = first * (1.0 - hyp)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        log_div = (r + x) * np.log((alpha + T) / (alpha + tx)) \
            + np.log(a / (b + np.maximum(x, 1.0) - 1.0))
        den = np.where(x > 0, 1.0 + np.exp(log_div), 1.0)
    return num / den


def expected_purchases(t: Column, frequency: Column, recency: Column, T: Column,
                       params: BetaGeoParams) -> Column:
    """H7 as an Arrow-batched column (one numpy series evaluation per batch)."""
    r, alpha, a, b = params.as_tuple()

    @F.pandas_udf("double")
    def _expected(t_: pd.Series, x_: pd.Series, tx_: pd.Series, T_: pd.Series) -> pd.Series:
        return pd.Series(expected_purchases_np(t_, x_, tx_, T_, r, alpha, a, b))

    return _expected(t.cast("double"), frequency.cast("double"), recency.cast("double"),
                     T.cast("double"))


def p_alive(frequency: Column, recency: Column, T: Column, params: BetaGeoParams) -> Column:
    """H8: probability the customer is still active (native column math)."""
    r, alpha, a, b = (F.lit(float(v)) for v in params.as_tuple())
    x = frequency.cast("double")
    log_div = (r + x) * F.log((alpha + T) / (alpha + recency)) \
        + F.log(a / (b + F.greatest(x, F.lit(1.0)) - 1))
    return F.when(frequency == 0, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(log_div)))


def gamma_gamma_value(frequency: Column, monetary: Column, params: GammaGammaParams) -> Column:
    """H9: conditional expected average spend (shrinkage of the customer mean
    towards the population mean)."""
    p, q, v = (F.lit(float(t)) for t in params.as_tuple())
    x = frequency.cast("double")
    w = p * x / (p * x + q - 1)
    pop = v * p / (q - 1)
    return (F.lit(1.0) - w) * pop + w * monetary


def discounted_clv(frequency: Column, recency: Column, T: Column, value: Column,
                   params: BetaGeoParams, months: int = 36, annual_rate: float = 0.10,
                   days_per_month: int = 30, incremental: bool = False) -> Column:
    """Sum over months m of E[purchases up to 30 m days] x value /
    (1 + i)^m with i = 1.1^(1/12) - 1.  The published sum uses cumulative
    purchases (over-counting); ``incremental=True`` uses each month's own."""
    r, alpha, a, b = params.as_tuple()
    rate = (1.0 + annual_rate) ** (1.0 / 12.0) - 1.0

    @F.pandas_udf("double")
    def _disc(x_: pd.Series, tx_: pd.Series, T_: pd.Series, v_: pd.Series) -> pd.Series:
        total = np.zeros(len(x_))
        prev = np.zeros(len(x_))
        for m in range(1, months + 1):
            cum = expected_purchases_np(np.full(len(x_), float(m * days_per_month)), x_, tx_, T_,
                                        r, alpha, a, b)
            purchases = cum - prev if incremental else cum
            prev = cum
            total += purchases * v_.to_numpy(dtype="float64") / (1.0 + rate) ** m
        return pd.Series(total)

    return _disc(frequency.cast("double"), recency.cast("double"), T.cast("double"),
                 value.cast("double"))


def probabilistic_clv(summary: DataFrame, bg: BetaGeoParams, gg: GammaGammaParams,
                      horizons=(30, 90, 365), discount: bool = True,
                      include_one_time: bool = False) -> DataFrame:
    """Expected purchases and CLV per horizon, 3-year discounted CLV
    and the tercile tier of CLV_365d.  Parity: repeat customers only."""
    base = summary if include_one_time else repeat_customers(summary)
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    out = base.withColumn("predicted_avg_value", gamma_gamma_value(x, F.col("monetary_value"), gg))
    out = out.withColumn("probability_alive", p_alive(x, tx, T, bg))
    for h in horizons:
        out = out.withColumn(f"predicted_purchases_{h}d", expected_purchases(F.lit(float(h)), x, tx, T, bg))
        out = out.withColumn(f"CLV_{h}d", F.col(f"predicted_purchases_{h}d")
                             * F.col("predicted_avg_value"))
    if discount:
        out = out.withColumn("CLV_3y_discounted",
                             discounted_clv(x, tx, T, F.col("predicted_avg_value"), bg))
    if 365 in horizons:
        out = materialize(out, "scores")  # the tier cut reads the scores twice
        out = qcut(out, "CLV_365d", 3, ["Low", "Medium", "High"], "CLV_Tier_Prob")
    return out


# ------------------------------------------------------------------ reports

def bgnbd_quadrants(scored: DataFrame, hi: float = 0.7, lo: float = 0.3,
                    col: str = "predicted_purchases_90d") -> DataFrame:
    """High Potential / At Risk / Loyal Low Spender / At Risk High
    Spender by P(alive) and the median of 90-day purchases; else Medium."""
    med = F.lit(quantile_table(scored, [col], [0.5])[col][0]).cast("double")
    pa, pp = F.col("probability_alive"), F.col(col)
    seg = (F.when((pa > hi) & (pp > med), F.lit("High Potential"))
           .when((pa < lo) & (pp < med), F.lit("At Risk"))
           .when((pa > hi) & (pp < med), F.lit("Loyal Low Spender"))
           .when((pa < lo) & (pp > med), F.lit("At Risk High Spender"))
           .otherwise(F.lit("Medium")))
    return scored.withColumn("segment", seg)


def quadrant_summary(segmented: DataFrame) -> DataFrame:
    """Count, %, mean purchases, mean P(alive), mean spend per segment."""
    total = segmented.agg(F.count(F.lit(1))).scalar()
    from patronage.operators.outputs import segment_action
    return segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("predicted_purchases_90d").alias("mean_predicted_purchases"),
        F.avg("probability_alive").alias("mean_probability_alive"),
        F.avg("monetary_value").alias("mean_monetary_value"),
    ).select("segment", F.col("customers").cast("long").alias("customers"),
             (F.col("customers").cast("double") * 100.0 / total.cast("double")).alias("pct"),
             "mean_predicted_purchases", "mean_probability_alive", "mean_monetary_value",
             segment_action(F.col("segment")).alias("action"))


def horizon_totals(scored: DataFrame, horizons=(30, 90, 365)) -> DataFrame:
    """Total, mean and median of each horizon's CLV, and of the 3-year
    discounted CLV (long format)."""
    cols = [f"CLV_{h}d" for h in horizons]
    if "CLV_3y_discounted" in scored.columns:
        cols.append("CLV_3y_discounted")
    values = materialize(scored.select(*cols), "horizons")
    medians = quantile_table(values, cols, [0.5], written=True)
    long = values.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("x"),
                                                     F.lit(medians[c][0]).cast("double").alias("m")) for c in cols])))
    return long.groupBy("measure").agg(F.sum("x").alias("total"), F.avg("x").alias("mean"), F.max("m").alias("median"))


def expected_transactions(scored: DataFrame) -> DataFrame:
    """Total expected purchases in the next 90 days and mean P(alive)."""
    return scored.agg(F.sum("predicted_purchases_90d").alias("expected_transactions_90d"),
                      F.avg("probability_alive").alias("mean_probability_alive"))


def scoring_grid(summary: DataFrame, params: BetaGeoParams, t: float = 90.0,
                 freq_max: int = 50, freq_step: int = 5, rec_max: int = 365,
                 rec_step: int = 30, with_purchases: bool = True) -> DataFrame:
    """P(alive) and expected purchases over a frequency x recency grid at
    T = mean T of the repeat customers; cells with recency >= T are 0.  The
    grid is generated from one ``range`` (no cross join)."""
    n_f = freq_max // freq_step + 1
    n_r = rec_max // rec_step + 1
    mean_t = repeat_customers(summary).agg(F.avg("T")).scalar()
    grid = summary.sparkSession.range(n_f * n_r).select(
        (F.floor(F.col("id") / n_r) * freq_step).cast("long").alias("frequency"),
        ((F.col("id") % n_r) * rec_step).cast("double").alias("recency"))
    grid = grid.withColumn("T", mean_t)
    live = F.col("recency") < F.col("T")
    out = grid.withColumn("probability_alive", F.when(
        live, p_alive(F.col("frequency"), F.col("recency"), F.col("T"), params)).otherwise(0.0))
    if with_purchases:
        out = out.withColumn("predicted_purchases", F.when(live, expected_purchases(
            F.lit(float(t)), F.col("frequency"), F.col("recency"), F.col("T"), params))
            .otherwise(0.0))
    return out


# FIXED VALUES - published example parameters (Fader, Hardie & Lee 2005,
# CDNOW sample; Gamma-Gamma example of Fader & Hardie).  Used for checks and
# fixed-parameter scoring, never as defaults of a fit.
PUBLISHED_BGNBD = BetaGeoParams(0.243, 4.414, 0.793, 2.426)
PUBLISHED_GAMMA_GAMMA = GammaGammaParams(6.25, 3.74, 15.44)

"""Quantile bins, ranks, top-k (F1-F8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.ordering import (
    approx_quantiles, exact_quantiles, global_row_number, quantile_table, rank_bins, top_mask)


def _edges(df: DataFrame, col: str, probs: Sequence[float], method: str = "rank") -> list[Column]:
    """Exact interpolated quantiles as columns.

    ``method='rank'`` uses the distributed selection (any column);
    ``'percentile'`` uses Spark's exact ``percentile`` aggregate, whose
    buffer holds one entry per DISTINCT value - only for columns with a
    bounded number of values, such as whole days of recency."""
    if method == "percentile":
        arr = df.agg(F.percentile(F.col(col), F.array(*[F.lit(float(p)) for p in probs]))
                     .alias("q")).scalar()
        return [arr[i] for i in range(len(probs))]
    return [F.lit(v).cast("double") for v in quantile_table(df, [col], probs)[col]]


def _check_increasing(edges: list[Column], what: str) -> Column:
    """A column that fails the job (like pandas) when edges repeat."""
    dup = F.lit(False)
    for a, b in zip(edges, edges[1:]):
        dup = dup | (a >= b)
    return F.when(dup, F.raise_error(F.lit(f"Bin edges must be unique for {what}")))


def qcut(df: DataFrame, col: str, q: int, labels: Sequence, out: str,
         duplicates: str = "raise", method: str = "rank") -> DataFrame:
    """pandas ``qcut(x, q, labels)``: edges are interpolated quantiles
    0, 1/q, ..., 1; bins are right-closed and the lowest value is included.
    ``duplicates='raise'`` fails like pandas when two edges coincide; ``'allow'``
    keeps the labels of the bins that are left; ``'merge'`` drops repeated edges
    and gives the remaining bins the first labels, in order."""
    probs = [i / q for i in range(q + 1)]
    edges = _edges(df, col, probs, method)
    idx = F.lit(1)
    for before, e in zip(edges, edges[1:-1]):
        step = F.col(col) > e
        if duplicates == "merge":
            step = step & (e > before)
        idx = idx + F.when(step, 1).otherwise(0)
    label = F.element_at(F.array(*[F.lit(v) for v in labels]), idx)
    label = F.when(F.col(col).isNotNull(), label)
    if duplicates == "raise":
        label = F.coalesce(_check_increasing(edges, col).cast(label_type(labels)), label)
    return df.withColumn(out, label)


def label_type(labels: Sequence) -> str:
    return "string" if isinstance(labels[0], str) else "int"


def rank_first(df: DataFrame, col: str, key: str = "CustomerID", out: str = "rank",
               ascending: bool = True, total: str | None = None) -> DataFrame:
    """``rank(method='first')``; ties keep key order."""
    order = [F.col(col).asc() if ascending else F.col(col).desc(), F.col(key).asc()]
    return global_row_number(df, order, name=out, total=total)


def qcut_of_rank(df: DataFrame, col: str, out: str, q: int = 4,
                 key: str = "CustomerID") -> DataFrame:
    """``qcut(x.rank(method='first'), q, labels=1..q)``, by comparison with the selected cut rows."""
    return rank_bins(df, col, key, out, q)


def tier_cut(df: DataFrame, col: str, out: str, low_q: float = 0.33, high_q: float = 0.66,
             duplicates: str = "raise") -> DataFrame:
    """Low (<= q33), Medium (<= q66), High; NULL stays NULL.
    pandas refuses equal cut points; ``duplicates='raise'`` does the same."""
    lo, hi = _edges(df, col, [low_q, high_q])
    x = F.col(col)
    tier = (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x <= lo, F.lit("Low")).when(x <= hi, F.lit("Medium"))
            .otherwise(F.lit("High")))
    if duplicates == "raise":
        tier = F.coalesce(_check_increasing([lo, hi], col).cast("string"), tier)
    return df.withColumn(out, tier)


def top_k(df: DataFrame, col: str, k: int, key: str = "CustomerID",
          largest: bool = True) -> DataFrame:
    """nlargest / nsmallest with ties by key and NULLs last (small k:
    Spark plans TakeOrderedAndProject, one bounded heap per partition)."""
    order = F.col(col).desc_nulls_last() if largest else F.col(col).asc_nulls_last()
    return df.filter(F.col(col).isNotNull()).orderBy(order, F.col(key).asc()).limit(k)


def top_share(df: DataFrame, col: str, share: float, key: str = "CustomerID") -> DataFrame:
    """F5 for k proportional to n: rows ranked within the top int(share*n)."""
    from fractions import Fraction
    frac = Fraction(share).limit_denominator(10_000)
    marked, _ = top_mask(df, col, key, lambda n: n * frac.numerator // frac.denominator, "_ts")
    return marked.filter("_ts").drop("_ts")


def overlap_size(a: DataFrame, b: DataFrame, key: str = "CustomerID") -> Column:
    """size of the intersection of two key lists, as a scalar column."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1))).scalar()


def scalar_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                     names: Sequence[str] | None = None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """F8: interpolated quantiles of one column as a 1-row DataFrame; with ``exact=False`` from a sketch, in
    one pass and off by at most n / ``accuracy`` ranks."""
    return exact_quantiles(df, col, probs, names) if exact else approx_quantiles(df, col, probs, names, accuracy)

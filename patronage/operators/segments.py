"""RFM segmentation and segment comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import np_round
from patronage.functions.lookups import segment_of_score, tier_of
from patronage.functions.money import amount, scale_of
from patronage.operators.binning import qcut, qcut_of_rank
from patronage.session import materialize


def rfm_scores(customers: DataFrame) -> DataFrame:
    """R (quartile of Recency, labels 4..1), F and M (quartile of the
    first-rank of Frequency and Monetary), RFM_Score and RFM_Sum."""
    # Recency is whole days: few distinct values, so Spark's exact percentile
    # aggregate is bounded; the two rank-based scores use the distributed rank
    scored = qcut(customers, "Recency", 4, [4, 3, 2, 1], "R_Score", method="percentile")
    scored = qcut_of_rank(scored, "Frequency", "F_Score")
    money = "monetary_cents" if "monetary_cents" in customers.columns else "Monetary"
    scored = qcut_of_rank(scored, money, "M_Score")
    return scored.withColumns({
        "RFM_Score": F.concat(F.col("R_Score").cast("string"), F.col("F_Score").cast("string"),
                              F.col("M_Score").cast("string")),
        "RFM_Sum": (F.col("R_Score") + F.col("F_Score") + F.col("M_Score")).cast("int"),
    })


def rfm_segments(customers: DataFrame) -> DataFrame:
    """G5 = G1-G4: scores plus the named Segment."""
    scored = rfm_scores(customers)
    return scored.withColumn("Segment", segment_of_score(F.col("RFM_Score")))


def segment_stats(segmented: DataFrame, by: str = "Segment", decimals: int | None = 2) -> DataFrame:
    """Mean Monetary, Frequency, Recency and count per segment, sorted by
    mean Monetary (rounded like pandas when ``decimals`` is set)."""
    rnd = (lambda c: np_round(c, decimals)) if decimals is not None else (lambda c: c)
    n = F.count(F.lit(1)).cast("double")
    return (segmented.groupBy(by).agg(
        rnd(amount(F.sum("monetary_cents"), scale_of(segmented, "monetary_cents")) / n).alias("Monetary"),
        rnd(F.sum("Frequency").cast("double") / n).alias("Frequency"),
        rnd(F.sum("Recency").cast("double") / n).alias("Recency"),
        F.count(F.lit(1)).alias("CustomerID"))
        .orderBy(F.col("Monetary").desc(), F.col(by)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and % of rows per value of a category."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .select(col, F.col("count").cast("long").alias("count"),
                    (F.col("count").cast("double") * 100.0 / total.cast("double")).alias("pct")))


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """E14 in long form: (row, col, count) for every observed row label and every
    observed column label, 0 where no row has both.

    The rows are counted once; the labels (segment, cluster and tier names) and
    the cells come from the written counts, one row per observed pair."""
    counts = materialize(df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
                         .groupBy(row, col).agg(F.count(F.lit(1)).alias("_c")), "crosstab")
    labels = counts.agg(F.collect_set(col)).scalar()
    cells = counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, "_c"))).alias("_m"))
    return (cells.withColumn("_l", labels).select(row, F.explode("_l").alias(col), "_m")
            .select(row, col, F.coalesce(F.try_element_at("_m", F.col(col)), F.lit(0)).cast("long").alias("count")))


def crosstab_wide(df: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    """``pd.crosstab`` layout; pass ``values`` to skip the distinct job."""
    return crosstab_long(df, row, col).groupBy(row).pivot(col, values).agg(F.sum("count")).na.fill(0)


def crosstab_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    """Share of all rows (x100) per cell of ``crosstab_long``, only rows with both keys."""
    cells = materialize(crosstab_long(df, row, col), "crosstab-cells")
    total = cells.agg(F.sum("count")).scalar()
    return cells.select(row, col, (F.col("count").cast("double") * 100.0 / total.cast("double")).alias("pct"))


def add_value_tiers(comparison: DataFrame, segment: str = "Segment",
                    cluster_name: str = "Cluster_Name") -> DataFrame:
    """RFM_Tier and Kmeans_Tier via the fixed name -> tier map."""
    return comparison.withColumns({"RFM_Tier": tier_of(F.col(segment)),
                                   "Kmeans_Tier": tier_of(F.col(cluster_name))})


def tier_agreement(tiers: DataFrame, a: str = "RFM_Tier", b: str = "Kmeans_Tier") -> DataFrame:
    """% of rows where both tiers are equal; NULL never agrees but counts."""
    return tiers.agg((F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double"))
                      * 100.0).alias("agreement_pct"))


def distinct_labels(df: DataFrame, *cols: str) -> DataFrame:
    """Number of distinct non-null values per column."""
    return df.agg(*[F.count_distinct(c).cast("long").alias(f"n_{c}") for c in cols])


def separation_ratio(df: DataFrame, by: str = "Segment",
                     cols: tuple[str, ...] = ("Recency", "Frequency", "Monetary")) -> DataFrame:
    """(TSS - WSS) / TSS over the raw columns, 0 when TSS = 0.

    TSS = sum over columns of var_pop * n; WSS = the same within each group.
    Two aggregations, no per-group loop.
    """
    wss_parts = df.groupBy(by).agg(*[
        (F.var_pop(F.col(c).cast("double")) * F.count(F.col(c))).alias(f"w_{c}") for c in cols])
    wss = wss_parts.agg(sum(F.sum(f"w_{c}") for c in cols).alias("wss"))
    tss = df.agg(*[(F.var_pop(F.col(c).cast("double")) * F.count(F.col(c))).alias(f"t_{c}")
                   for c in cols]).select(sum(F.col(f"t_{c}") for c in cols).alias("tss"))
    t = tss.select("tss").scalar()
    return wss.select(F.when(t > 0, (t - F.col("wss")) / t).otherwise(F.lit(0.0))
                      .alias("separation_ratio"))

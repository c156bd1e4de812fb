"""Fixed vocabularies that results depend on.

FIXED VALUES: the texts and patterns below must stay exactly as written for
results to match the published analysis (segment names, their score
patterns in priority order, the tier of each segment / cluster name, and the
names given to cluster ids).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES - RFM score pattern -> segment, in the published order.  Every
# pattern is matched at the start of the 3-digit score; a later match
# overrides an earlier one, and scores matching none are "Others".
SEGMENT_PATTERNS: list[tuple[str, str]] = [
    (r"111|112|121|131|141|151", "Hibernating"),
    (r"[1-2][1-3][1-2]", "At Risk"),
    (r"[1-2]4[1-2]", "Cant Lose"),
    (r"[1-2][1-2][3-4]", "About to Sleep"),
    (r"[1-2][3-4][3-4]", "Need Attention"),
    (r"3[1-2][1-3]", "Promising"),
    (r"33[1-3]", "Potential Loyalists"),
    (r"[3-4][1-3]4", "Loyal"),
    (r"4[1-2]4", "Champions"),
    (r"[3-4][3-4][3-4]", "Loyal Customers"),
    (r"[1-2]4[3-4]", "High Spenders"),
    (r"[3-4]4[1-2]", "New Customers"),
]
DEFAULT_SEGMENT = "Others"

# FIXED VALUES - value tier of RFM segments and k-means cluster names.
# Names absent here ("Loyal", "New Customers", "Others") have no tier (NULL).
TIER_OF_NAME: dict[str, str] = {
    "Champions": "High",
    "Loyal Customers": "High",
    "High Spenders": "High",
    "High-Value Loyal Customers": "High",
    "Potential Loyalists": "Medium",
    "Need Attention": "Medium",
    "Promising": "Medium",
    "Mid-Value Regulars": "Medium",
    "At Risk": "Low",
    "Cant Lose": "Low",
    "About to Sleep": "Low",
    "Hibernating": "Low",
    "Low-Value Occasional Buyers": "Low",
    "At-Risk Customers": "Low",
}

# FIXED VALUES - names of k-means cluster ids 0..3.
CLUSTER_NAMES: dict[int, str] = {
    0: "High-Value Loyal Customers",
    1: "Mid-Value Regulars",
    2: "Low-Value Occasional Buyers",
    3: "At-Risk Customers",
}

# FIXED VALUES - ordinal of the three value tiers.
TIER_ORDER = ["Low", "Medium", "High"]

# FIXED VALUES - weekday names, Monday first.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def segment_of_score(score: Column) -> Column:
    """Segment of a 3-character RFM score: later patterns take priority, so
    the CASE tests them from last to first."""
    expr = None
    for pattern, name in reversed(SEGMENT_PATTERNS):
        cond = score.rlike(f"^(?:{pattern})")
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_SEGMENT))


def map_lookup(col: Column, mapping: dict) -> Column:
    """Dictionary lookup as a literal map; unknown keys give NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col)


def tier_of(name: Column) -> Column:
    return map_lookup(name, TIER_OF_NAME)


def cluster_name(cluster: Column) -> Column:
    return map_lookup(cluster.cast("int"), CLUSTER_NAMES)

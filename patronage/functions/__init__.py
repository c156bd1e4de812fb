from patronage.functions.columns import (
    elapsed_days, weekday_mon0, safe_div, clip, np_round, coerce_double, cents_to_money,
    non_null_distinct_count)
from patronage.functions.ordering import (
    Selection, approx_quantiles, exact_quantiles, global_row_number, pairs_at, quantile_table, quartile_of_rank,
    rank_bins, top_mask)
from patronage.functions.money import amount, scale_of, units

__all__ = [
    "elapsed_days", "weekday_mon0", "safe_div", "clip", "np_round", "coerce_double",
    "cents_to_money", "non_null_distinct_count", "global_row_number", "exact_quantiles",
    "quartile_of_rank", "Selection", "approx_quantiles", "pairs_at", "quantile_table", "rank_bins", "top_mask",
    "amount", "scale_of", "units",
]

from tidemark.operators.grouping import grouped_subsets, top_per_group
from tidemark.operators.joins import band_join, with_match, without_match
from tidemark.operators.ordered import OrderedGroups
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.sets import bag_difference, common_rows
from tidemark.operators.timelines import consecutive_days, hop_windows, last_before, sessions

__all__ = [
    "OrderedGroups",
    "bag_difference",
    "band_join",
    "common_rows",
    "consecutive_days",
    "exact_quantiles",
    "grouped_subsets",
    "hop_windows",
    "last_before",
    "sessions",
    "top_per_group",
    "with_match",
    "without_match",
]

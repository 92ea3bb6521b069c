from tidemark.functions.exact import as_double, exact, exact_sum, merged_sums, named, part_sums, sum_of, units
from tidemark.functions.ranking import ntile_of, percent_rank_of
from tidemark.functions.user import GreedyBatches, aggregate_in_batches

__all__ = [
    "GreedyBatches",
    "aggregate_in_batches",
    "as_double",
    "exact",
    "exact_sum",
    "merged_sums",
    "named",
    "ntile_of",
    "part_sums",
    "percent_rank_of",
    "sum_of",
    "units",
]

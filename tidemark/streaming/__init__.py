from tidemark.streaming.dedup import first_within
from tidemark.streaming.joins import matched_within, with_lookup
from tidemark.streaming.sinks import run_to_table
from tidemark.streaming.state import running_counts
from tidemark.streaming.windows import session_sums, window_sums

__all__ = [
    "first_within",
    "matched_within",
    "run_to_table",
    "running_counts",
    "session_sums",
    "window_sums",
    "with_lookup",
]

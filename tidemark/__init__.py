"""Analytics over tables and event streams, written with Spark's own APIs."""

import sys

from pyspark import cloudpickle

from tidemark.session import build_session, prepare, shared_dir

# the library's Python functions travel inside the plans that use them, so executors need
# pandas and pyarrow but no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "prepare", "shared_dir"]

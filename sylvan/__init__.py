"""sylvan: versioned-tree analytics on PySpark.

Trees (source code, markup, JSON or any typed hierarchy) and their histories are
kept as DataFrames; patterns, metrics, diffs and tracking are Spark plans on them.
"""

import sys

from pyspark import cloudpickle

from sylvan.engine import Engine

# Functions of this package travel to the executors by value, so a job does not need the
# library installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Engine"]

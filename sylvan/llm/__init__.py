"""Operators for preparing large language-model training corpora.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a job does not
# need the library installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

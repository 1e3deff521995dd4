"""Out-of-core analytics on sparse entity-by-feature matrices, and training-data operators, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value, so executors need no installation of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

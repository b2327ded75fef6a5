"""Gradient boosting and corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

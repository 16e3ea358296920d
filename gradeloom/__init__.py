"""Evaluation and weight analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so a cluster does not
# need this package installed on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]

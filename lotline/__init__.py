"""Auction analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel whole: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

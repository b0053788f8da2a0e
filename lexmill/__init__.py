"""lexmill: text-corpus analytics on Spark DataFrames, SQL and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Workers get the library's functions by value, so they need neither its folder nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

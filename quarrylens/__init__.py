"""Facts about programs and documents as DataFrames: graphs, references, search, classification, reports."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

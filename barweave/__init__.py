"""barweave: market-bar analytics as lazy Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers travel with the task,
# so executors need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

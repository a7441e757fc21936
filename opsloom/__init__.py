"""Spark-native analytics for agent operations, claims audit, retrieval and governed warehouses.

Every operator is a function from DataFrames to DataFrames; nothing here collects data on the driver
unless a docstring says so and names the bound.
"""

import sys

from pyspark import cloudpickle

# The small Python helpers travel to the executors inside the tasks, so that workers need neither
# this package on their path nor the driver's working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

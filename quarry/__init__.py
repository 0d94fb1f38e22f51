"""quarry: a Spark-native analytics engine.

Operators take and return DataFrames; Catalyst, AQE and Parquet do the planning, execution and storage.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so that a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

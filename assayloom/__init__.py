"""assayloom: Spark-native analytics for sample x feature matrices and the graph of findings drawn from them."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value: they need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""herdbook: a PySpark-native engine for building and analysing registries of places.

Functions that run in Python workers are pickled by value, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native analytics over scholarly manuscripts and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

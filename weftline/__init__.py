"""weftline: a PySpark-native engine for text corpora and record streams."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need no copy of this package and no shared import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

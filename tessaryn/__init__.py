"""tessaryn: governance of decision records and preparation of training data on Spark.

Every public operator takes and returns DataFrames and stays lazy unless its
docstring says that it writes an intermediate table.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _pickle

# Functions that run in Python workers travel by value: executors need not have this package.
_pickle.register_pickle_by_value(_sys.modules[__name__])

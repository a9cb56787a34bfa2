"""Spark-native analytics for function-level code-risk triage.

Every operator takes and returns DataFrames.  Workers get the Python functions
of this package by value, so executors need no copy of the package on disk.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

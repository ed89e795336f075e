"""Sieveline: a Spark-native engine for listing intelligence and corpus preparation.

Importing the package registers it with PySpark's pickler *by value*, so that the functions which run
in Python workers travel with the tasks and executors need no copy of the repository.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

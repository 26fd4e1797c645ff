"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

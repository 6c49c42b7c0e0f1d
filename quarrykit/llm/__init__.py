"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions by value, so the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

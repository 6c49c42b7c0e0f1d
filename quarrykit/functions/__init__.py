"""Functions: those that generate rows, types by name, and other dialects' spellings."""

import sys

from pyspark import cloudpickle

# Executors get what generates rows by value, so the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

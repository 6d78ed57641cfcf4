"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors may have no copy of the library: functions sent to them travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

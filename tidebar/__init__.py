"""Tick-to-bar analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their tasks, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

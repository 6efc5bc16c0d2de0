"""Lag-based causality discovery on time-series panels, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's Arrow functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

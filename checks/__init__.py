"""Registered queries over the test tables and their SQL counterparts."""

import sys

from pyspark import cloudpickle

# the callables handed to operators travel by value, as in kinspot
cloudpickle.register_pickle_by_value(sys.modules[__name__])

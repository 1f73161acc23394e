"""kinspot: finding copied text and code, and auditing keyed tables, on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); the data never passes through the driver.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

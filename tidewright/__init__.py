"""tidewright: preparing, forecasting and auditing many time series with Spark.

All operators take and return DataFrames.  A *panel* is a long table with key columns
(any number, also none), a date column ``ds`` and a value column ``y``; it holds one row
per (keys, ds), so one series is never longer than its calendar.  Operators that accept
raw rows aggregate them (with map-side combine) before anything is partitioned by key.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

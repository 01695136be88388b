"""Contract analytics as Spark DataFrame operators.

``operators`` hold the work (DataFrames in, DataFrames out), ``functions`` the
Column expressions they share, ``sources`` what reads and writes tables,
``streaming`` the Structured Streaming jobs and ``plans`` the registered
queries with the SQL they are checked against.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Arrow functions travel to the executors by value, so the package need not be
# installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

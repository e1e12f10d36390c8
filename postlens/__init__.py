"""postlens: job-market analytics as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package run inside Python workers (pandas UDFs,
# mapInPandas). Ship them by value, so executors need no copy of the package
# on their path (a cluster, or a driver started from another directory).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with addPyFile instead
    pass

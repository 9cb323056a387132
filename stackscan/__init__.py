"""Technology fingerprinting of crawled pages as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from stackscan.model import ScanConfig

# Functions of this package travel to the executors by value, so they need no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ScanConfig"]

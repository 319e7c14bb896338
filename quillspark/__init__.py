"""quillspark: review-corpus analytics as DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

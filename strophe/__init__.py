"""Timed-text and note-chart analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run inside tasks travel with the job, so that
# executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

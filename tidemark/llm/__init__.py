"""Operators of a training-data pipeline on documents and pages; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# executors get the code of the tasks with the tasks, so that only Spark and its Python need to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

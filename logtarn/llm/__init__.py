"""Operators of a training-data pipeline: one module each, its query beside it."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# What runs in Python workers travels with the job, so executors need no copy of the library.
register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline: scoring, filtering, deduplication, packing and search.

Functions of this subpackage that run in tasks are sent to the executors by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data corpora; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need no copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

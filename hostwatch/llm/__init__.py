"""Operators of a training-data pipeline over documents and conversations."""

import sys

from pyspark import cloudpickle

# Python workers get functions of this package by value: executors need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

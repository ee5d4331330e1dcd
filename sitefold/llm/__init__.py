"""Operators for preparing training data.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks receive this subpackage's functions by value: executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

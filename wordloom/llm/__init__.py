"""Operators for training-data corpora: search, dedupe, scoring, mixing, packing, archives."""

import sys

from pyspark import cloudpickle

# Python workers may start where this package is not installed: send its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

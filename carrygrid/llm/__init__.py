"""Operators for training-data pipelines: dedup, filters, tokens, packing."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with the plan, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

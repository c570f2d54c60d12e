"""Operators of a training-data pipeline: filters, deduplication, tokens, archives, mixing."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in Python workers with the job; workers need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

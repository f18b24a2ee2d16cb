"""Operators of a training-data pipeline over the corpus tables."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks are sent with their code, so that workers
# need numpy, pyarrow and xxhash, but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

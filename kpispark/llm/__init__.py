"""Operators for preparing training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# The operators' Python functions travel to the workers by value: executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators of a training-data pipeline. Nothing outside this package imports it.

Functions that run on executors are pickled by value, so workers need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

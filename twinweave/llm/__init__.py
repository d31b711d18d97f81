"""Operators of a training-data pipeline.

Functions that run inside tasks travel with the tasks, so executors need Python, NumPy
and Arrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

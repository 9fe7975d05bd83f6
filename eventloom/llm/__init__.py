"""Operators for preparing training corpora.

The functions that run in Python workers are pickled by value, so executors need none of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

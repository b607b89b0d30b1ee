"""Training-data operators. Nothing else in the package imports this one.

Functions that run in Python workers are pickled by value, so executors need
neither this package on their path nor a shared install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

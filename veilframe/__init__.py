"""Privacy-preserving data profiles of tables, as Spark plans.

Functions that run in Python workers are pickled by value, so executors need no install of this package.
"""

import sys

from pyspark import cloudpickle

from .errors import InvalidInputError, UnsupportedFormatError, VeilError
from .options import Options

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["InvalidInputError", "Options", "UnsupportedFormatError", "VeilError"]

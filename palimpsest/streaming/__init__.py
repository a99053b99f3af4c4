"""The store as a stream; what goes to Python workers is pickled by value, so executors need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

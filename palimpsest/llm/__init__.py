"""Operators for preparing training corpora.

Each module holds one operator with a general interface; :mod:`.queries`
registers the thin contract queries.  Functions sent to Python workers are
pickled by value, so executors need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing text corpora; nothing else in the package imports them.

Their functions travel to Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

Functions of these modules run on executors by value: workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

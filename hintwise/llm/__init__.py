"""Operators for preparing training corpora. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# functions run in Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

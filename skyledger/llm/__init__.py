"""Operators for preparing language-model training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

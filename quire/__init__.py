"""quire: a PySpark-native engine for extracting, ranking, cleaning and assembling text.

Functions that run in Python workers are pickled by value, so executors need only the
third-party packages, not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Analytics of time-ordered events, token sequences and training corpora on Spark.

Functions that run in Python workers are shipped by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""A PySpark-native analytics engine.

Functions that run on executors are sent there by value, so that the package need not be installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

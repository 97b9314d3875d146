"""A PySpark-native code-intelligence and retrieval engine.

The functions that run on executors are shipped by value, so a cluster needs
the libraries there, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

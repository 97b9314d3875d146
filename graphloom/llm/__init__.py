"""Training-data operators.  Nothing outside this subpackage imports it.

The functions that run on executors are shipped by value, so a cluster needs
numpy, pyarrow and the encoder libraries there, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

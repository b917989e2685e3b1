"""Analytics over versioned public evidence, and training-data operators, as Spark plans."""

import sys

from pyspark import cloudpickle

# Workers get functions by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

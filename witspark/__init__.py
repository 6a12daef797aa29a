"""Evidence analytics on Spark: DataFrame operators over event tables."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so that executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

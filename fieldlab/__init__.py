"""fieldlab: a PySpark-native engine for gridded fields, held as ordinary DataFrames."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

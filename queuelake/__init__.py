"""Queue analytics on PySpark: every operator is a function from DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: the package needs not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

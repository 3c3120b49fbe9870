"""Binary risk modelling on tabular survey data, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

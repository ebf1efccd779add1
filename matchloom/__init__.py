"""Entity matching and standardisation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

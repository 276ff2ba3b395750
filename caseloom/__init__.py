"""Case-history analytics on Spark.

Functions that run in tasks travel by value, so that workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

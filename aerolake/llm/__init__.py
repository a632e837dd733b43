"""Training-data pipeline operators.

Functions that run on executors are shipped by value, so that workers need not
be able to import this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""noticelab: notices of corporate actions as Spark DataFrames, from read blocks to a triaged record.

Functions are sent to the Python workers by value, so that a worker needs no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

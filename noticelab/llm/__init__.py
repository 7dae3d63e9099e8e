"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Its functions are sent
to the Python workers by value, so that a worker needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

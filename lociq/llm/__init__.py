"""Training-data operators.  Nothing outside this subpackage imports it.

Kernels run on executors that need not have this repository on their path, so
the package is pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

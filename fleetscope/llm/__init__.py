"""Training-data pipeline operators (one module per operator).

Functions that run on executors are pickled by value, so workers need only the
public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

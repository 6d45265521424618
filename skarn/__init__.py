"""skarn: Spark operators for hazard monitoring and ML-platform operations data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the few functions they run with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""graniteloom: code-security and training-corpus analytics on PySpark."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions handed to executors travel with the job, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

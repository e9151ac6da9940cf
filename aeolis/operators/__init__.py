import sys

from pyspark import cloudpickle

# Executors get the helpers of these modules inside the task, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

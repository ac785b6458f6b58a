"""Transit headway analytics expressed as Spark DataFrame transformations."""
import sys

from pyspark import cloudpickle

# Grouped pandas functions travel to the executors by value, so a job works on
# a cluster where this package is installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

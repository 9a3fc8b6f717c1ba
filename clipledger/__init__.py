"""Event-evidence analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python steps are sent to the executors by value, so a job needs no package
# installation or --py-files there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

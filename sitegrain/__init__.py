"""Spark-native operators for captured web pages."""

import sys

from pyspark import cloudpickle

# The few Python stages travel to the executors with the job, so that these need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

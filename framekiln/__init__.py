"""Spark jobs that prepare image-caption data for training runs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the cluster needs
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Queries over the given tables, and the SQL that checks them."""

import sys

from pyspark import cloudpickle

# Toy encoders and taggers travel with the job, like the library's own functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

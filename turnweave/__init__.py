"""Spark operators for time-aligned speech transcripts."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code: a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

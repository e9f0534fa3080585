"""Similarity retrieval and corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: nothing of this package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

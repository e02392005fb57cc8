"""cardwatch: card-fraud feature, training, evaluation and scoring jobs on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

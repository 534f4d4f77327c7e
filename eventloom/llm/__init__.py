"""Operators that prepare text corpora for training. Nothing else imports this package."""

import sys

from pyspark import cloudpickle

# Functions travel with their code: executors need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

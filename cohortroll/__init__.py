"""Cohort roll-ups on Spark: cells and sparse counts to trustworthy sample-level statistics."""

import sys

from pyspark import cloudpickle

# Helpers used inside tasks travel with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

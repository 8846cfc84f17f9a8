"""Conversation-safety analytics as Spark column expressions and operators."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

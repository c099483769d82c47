"""Spark-native jobs for visual-question-answering evaluation data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

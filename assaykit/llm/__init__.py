"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
import sys

from pyspark import cloudpickle

# Functions that run on executors are sent whole, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

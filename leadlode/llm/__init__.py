"""Operators for preparing language-model training data.

Their Python code travels with the tasks that run it, so executors need not have it installed.
"""

import sys

from pyspark.cloudpickle import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

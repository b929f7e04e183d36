"""Operators for the preparation of language-model training data.

Nothing else in the library imports this subpackage. Functions sent to Python workers travel whole,
so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

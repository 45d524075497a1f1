"""Operators for preparing training corpora at scale.

Self-contained: nothing outside this subpackage imports it, and it imports nothing from the rest of
the library.
"""

import sys

from pyspark import cloudpickle

# functions for Python workers travel whole: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

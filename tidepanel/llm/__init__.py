"""Operators for large training corpora: one module each, queries in ``queries``.

Functions of this package that run inside Python workers travel by value, so
executors need numpy and pyarrow but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

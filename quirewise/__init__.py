"""quirewise: a PySpark engine for analysing collections of text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's functions with the plan, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

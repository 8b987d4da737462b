"""Operations of a large-scale training-data pipeline.  Nothing else in the library imports this package.

Functions of this package go to Python workers by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operations of a large-scale training-data pipeline, one module each.

Nothing else in the library imports this subpackage. Functions that run in Spark's
Python workers are shipped by value, so executors need numpy and pyarrow but no copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

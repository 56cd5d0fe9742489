"""labelgrid: label-mask analytics on sparse Spark DataFrames.

A mask, a prediction or an annotation is a table of its non-zero cells
``(image_id, y, x, class_id, v)``; page extents live in ``images``
``(image_id, height, width, n_classes)``. Every operator is a function from
DataFrames to a DataFrame.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# the few functions sent to Python workers travel with their code, so executors
# do not need the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: clean, identify, de-duplicate, mix, shard, encode."""

import sys

from pyspark import cloudpickle

# Tasks get the code of these modules with the task, so that the workers need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Spark-native building of language-model fine-tuning datasets.

Every operator takes a DataFrame (or a Column) and returns one; nothing runs until a sink is called.
"""

import sys

from pyspark import cloudpickle

# The few Python batch functions of this package travel inside the task closure, so executors need
# no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

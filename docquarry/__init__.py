"""docquarry: chunk, embed, store, retrieve and report on document tables with Spark.

Every operator is a function from DataFrames to a DataFrame; nothing here owns
data or schedules work. See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Send this package's task functions along with the plan, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

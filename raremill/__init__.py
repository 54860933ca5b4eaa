"""raremill: learning from rare events in large tables and streams, on PySpark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions sent to executors carry their code, so the package need not be installed there
register_pickle_by_value(sys.modules[__name__])

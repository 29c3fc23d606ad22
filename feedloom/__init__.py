"""feedloom: analytics over noisy event feeds, as declarative Spark plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need not have this package installed: its functions travel with the plan.
register_pickle_by_value(sys.modules[__name__])

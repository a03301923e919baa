"""gigsift: listing triage as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions of the package travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

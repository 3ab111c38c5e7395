"""tunegrain: fine-tuning data preparation and run telemetry on PySpark.

Every operator is a function from DataFrame (or Column) to DataFrame (or Column),
so Catalyst plans the work and the cluster runs it.
"""

import sys

from pyspark import cloudpickle

from tunegrain.schema import DatasetInfo, FieldMapping, TaskFormat, guess_mapping
from tunegrain.session import build_session

__all__ = ["DatasetInfo", "FieldMapping", "TaskFormat", "build_session", "guess_mapping"]

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

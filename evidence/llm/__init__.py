"""Operators of a training-data pipeline. Nothing else in the library imports this folder."""

from pyspark import cloudpickle

import evidence

# Workers need no installed copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(evidence)

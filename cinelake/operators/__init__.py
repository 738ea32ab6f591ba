"""DataFrame operators. Task-side helpers are pickled by value, so executors need no installed copy of the package."""

from pyspark import cloudpickle

from cinelake.functions import grouped
from cinelake.operators import audio, containers

for _module in (audio, containers, grouped):
    cloudpickle.register_pickle_by_value(_module)

"""Fleet-of-batch-jobs analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

from fleetframe.session import build_session, configure, work_dir

__all__ = ["build_session", "configure", "work_dir"]

# Python functions go to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

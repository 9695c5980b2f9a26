"""Load of a server from its advertised numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AD_COLUMNS = ["name", "address", "max_jobs", "running", "duty_cycle", "idle"]


def server_weight(duty_cycle: Column, running: Column, max_jobs: Column, idle: Column) -> Column:
    """70% duty cycle, 20% occupancy (both in percent), 10% idle jobs.

    A server that can run nothing has no weight (null).
    """
    occupancy = F.try_divide(running.cast("double"), max_jobs.cast("double")) * 100
    return 0.7 * (duty_cycle * 100) + 0.2 * occupancy + 0.1 * idle

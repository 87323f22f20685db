"""Named queries over the test tables, each with its SQL oracle where one exists."""

from tapeworks.plans import bars, jobs, models, rows, warehouse  # noqa: F401
from tapeworks.plans.catalog import CATALOG

__all__ = ["CATALOG"]

"""An expression that is needed more than once, bound to a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: it is bound to a lambda's variable, so the plan holds its expression once
    however often ``use`` needs it."""
    return F.transform(F.array(value), use)[0]

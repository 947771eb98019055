"""All checkable queries, by the ids of the operator inventory."""

# The order matters: later modules reuse SQL pieces of earlier ones.
from gridspark.registry import rows  # noqa: F401, I001
from gridspark.registry import spatial  # noqa: F401
from gridspark.registry import statistics  # noqa: F401
from gridspark.registry import grids  # noqa: F401
from gridspark.registry import places  # noqa: F401
from gridspark.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

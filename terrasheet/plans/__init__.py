"""All queries over the reference's operators."""

from . import aggregates, details, files, iterations, joins, layers, more, regions, scalars, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""Operators by family; importing this package registers their queries."""

from queuelake.operators import features, joins, latest, lookup, matching, quality, rollup, serving, stats, windows  # noqa: F401
from queuelake.registry import REGISTRY  # noqa: F401
from queuelake.sources import readers, sinks  # noqa: F401
from queuelake.streaming import delta  # noqa: F401

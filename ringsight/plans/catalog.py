"""Query name -> function, and query name -> SQL."""

from ringsight.plans import aggregates, federated, learning, rowwise  # noqa: F401
from ringsight.plans.base import ORACLES, QUERIES  # noqa: F401

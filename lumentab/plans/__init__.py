"""The registered queries; importing this package fills ``REGISTRY``."""

from lumentab.plans import content, learning, recommend, relational, scalars, sky, statistics, storage  # noqa: F401
from lumentab.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

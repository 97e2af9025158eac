"""Named queries: the operators run over the given tables, with a SQL twin where one exists."""

from tapeloom.plans.base import REGISTRY, Archive, with_views
from tapeloom.plans import decisions, features, ingest, passages, review, states, streams, vectors  # noqa: F401

__all__ = ["REGISTRY", "Archive", "with_views"]

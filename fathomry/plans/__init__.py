"""Named queries: importing this package registers them all."""

from . import contrastive, files, flows, prep, retrieval  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

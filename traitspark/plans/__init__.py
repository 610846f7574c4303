"""Registered queries over the driver tables."""

from . import exploring, ingest, modelling, testing  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

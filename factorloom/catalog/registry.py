"""All registered queries; importing the modules fills the registry."""

from factorloom.catalog import inputs_outputs, market, operations, research  # noqa: F401
from factorloom.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

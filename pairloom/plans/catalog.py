"""All registered queries; importing the modules enters them."""

from pairloom.plans import (  # noqa: F401
    conversion, curation, files, sampling, scalars, scoring, shaping,
)
from pairloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

"""Imports every plan module so that the registry is complete."""

from barweave.plans import context, core, dataset, landing, learning, strategy, technical  # noqa: F401
from barweave.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

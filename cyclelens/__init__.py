"""Delivery analytics on Spark: how AI-assisted commits relate to issue cycle time."""

from cyclelens.domain import Domain

__all__ = ["Domain"]

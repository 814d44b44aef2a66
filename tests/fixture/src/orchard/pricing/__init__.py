"""Money."""

from .rates import TARIFF, discounted

__all__ = ["TARIFF", "discounted"]

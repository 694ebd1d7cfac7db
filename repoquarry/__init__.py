"""Repository analytics on Spark."""

from repoquarry.api import Repositories

__all__ = ["Repositories"]

"""Feature discovery over table collections, expressed as Spark DataFrame jobs."""

from joingrove.session import Augmenter

__all__ = ["Augmenter"]

"""spandoc: Spark-native analytics for entities that carry ordered, labelled spans."""

from spandoc.schemas import LabelScheme, DEFAULT_SCHEME

__all__ = ["LabelScheme", "DEFAULT_SCHEME"]

"""punctual: public-transport reliability analytics as Spark jobs."""

from punctual.config import Config

__all__ = ["Config"]

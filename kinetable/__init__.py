"""kinetable: Spark operators for building and checking motion-capture datasets."""

from kinetable.config import Config

__all__ = ["Config"]

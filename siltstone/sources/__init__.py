"""Sources and sinks."""

from . import files

__all__ = ["files"]

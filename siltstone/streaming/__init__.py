"""Structured Streaming operators."""

from . import watch

__all__ = ["watch"]

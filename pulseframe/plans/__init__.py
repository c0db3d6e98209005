"""Driver tables as recordings, and the registered queries."""

from . import dimensions, registry

__all__ = ["dimensions", "registry"]

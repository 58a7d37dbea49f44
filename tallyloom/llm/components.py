"""Connected components with DataFrame operations only, shared with the rest of the library."""

from ..operators.components import connected_components

__all__ = ["connected_components"]

"""Connected components of a distributed list of links; the library's own operator."""

from ..operators.graph import connected_components  # noqa: F401

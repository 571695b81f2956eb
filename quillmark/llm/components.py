"""Components over tables and spanning labels inside a task, from the core."""

from ..operators.graph import connected_components, spanning

__all__ = ["connected_components", "spanning"]

"""The library's connected components, under the name that this subpackage's modules use."""

from ..operators.components import components

__all__ = ["components"]

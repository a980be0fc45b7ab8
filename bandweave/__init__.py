"""A windowed band-join engine on PySpark: batch and streaming, with sources, window-state operators and benchmarks."""

from bandweave.plans.spec import BandJoinSpec

__all__ = ["BandJoinSpec"]

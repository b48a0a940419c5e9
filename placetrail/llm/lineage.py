"""Cutting lineage; see placetrail.functions.lineage."""

from ..functions.lineage import cut, discard, release, shared_folder

__all__ = ["cut", "discard", "release", "shared_folder"]

"""Incremental computation: keys that aren't there yet are computed, one transaction each."""

from .jobs import Jobs
from .populate import Computed, Imported

__all__ = ["Computed", "Imported", "Jobs"]

"""Where intermediate tables go, and how lineage is cut: as in the rest of the library."""

from veritab.runtime import materialise, shared_dir

__all__ = ["materialise", "shared_dir"]

"""Intermediate tables in the folder that the driver and all executors share."""

from lodestone.store import drop, new_path, shared_dir, shuffled, temporary, written

__all__ = ["drop", "new_path", "shared_dir", "shuffled", "temporary", "written"]

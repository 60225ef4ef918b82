"""Intermediate tables in the folder that driver and executors share."""

from lapwing.sources.shared import drop, new_path, save, shared_dir

__all__ = ["drop", "new_path", "save", "shared_dir"]

"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from vellumspark.staging import new_path, shared_dir, staged

__all__ = ["new_path", "shared_dir", "staged"]

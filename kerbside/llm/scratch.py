"""The shared folder for tables between steps; see ``kerbside.scratch``."""

from kerbside.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

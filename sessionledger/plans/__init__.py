"""Skew-safe building blocks for ordered computations."""
from .fold import STATE, Machine, Prefix, chunked_fold
from .scan import Run, default_span, running, with_chunk
from .store import ensure_checkpoint_dir, scratch_path, written_table

__all__ = ["STATE", "Machine", "Prefix", "Run", "chunked_fold", "default_span", "ensure_checkpoint_dir", "running", "scratch_path", "with_chunk", "written_table"]

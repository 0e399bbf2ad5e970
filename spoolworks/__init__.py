"""spoolworks: fine-tuning data preparation and run analysis as Spark DataFrame operators."""

from .session import build_session, scratch_path, scratch_root, write_through

__all__ = ["build_session", "scratch_path", "scratch_root", "write_through"]

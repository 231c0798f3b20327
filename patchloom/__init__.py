"""Pull-request and commit analytics as Spark DataFrame jobs."""

from patchloom.session import build_session, prepare, scratch_dir

__all__ = ["build_session", "prepare", "scratch_dir"]

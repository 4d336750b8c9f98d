"""rowmill: ETL operators as plain DataFrame functions."""

from rowmill.session import build_session, configure, materialize, scratch_path

__all__ = ["build_session", "configure", "materialize", "scratch_path"]

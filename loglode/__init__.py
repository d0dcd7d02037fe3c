"""Log-to-source search and code-log analytics as Spark jobs."""

from loglode.session import build_session, tune

__all__ = ["build_session", "tune"]

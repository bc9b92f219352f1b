"""tidings: news-opinion analytics as Spark DataFrame jobs."""

from .session import ensure_session, local_session

__all__ = ["ensure_session", "local_session"]

"""Reading-data engine on PySpark: web pages, paged text and plain text to clean blocks."""

from leafmill.session import configure, local_session

__all__ = ["configure", "local_session"]

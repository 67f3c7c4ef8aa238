"""Change-data-capture auditing as Spark DataFrame operators."""

from changetide.session import configure, get_session

__all__ = ["configure", "get_session"]

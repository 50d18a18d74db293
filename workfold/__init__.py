"""Work-log analytics on Spark: lifecycle logs, journals, policies and streams as DataFrame plans."""

from workfold.session import build_session

__all__ = ["build_session"]

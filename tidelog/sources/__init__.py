"""Where logs come from: tables that are viewed as logs, and the store that can append."""

from .connectors import as_log, log_from_files, log_from_jdbc
from .logs import conversation_log, events_log, log_from, order_log
from .store import EventStore

__all__ = ["EventStore", "as_log", "conversation_log", "events_log", "log_from", "log_from_files", "log_from_jdbc", "order_log"]

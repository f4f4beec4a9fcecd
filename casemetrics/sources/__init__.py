from casemetrics.sources.tables import (
    CaseTables,
    LiveView,
    live_view,
    publish_changes,
    publish_table,
    publish_view,
    read_tables,
)

__all__ = ["CaseTables", "LiveView", "live_view", "publish_changes", "publish_table", "publish_view", "read_tables"]

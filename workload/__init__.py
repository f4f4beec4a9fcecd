"""The library applied to the given tables: role mapping, registered queries, comparison SQL."""

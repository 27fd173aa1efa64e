"""Feeds, archives and reference tables: from raw rows to tables, in batches or streams."""

"""Stand-in views and the query catalogue."""

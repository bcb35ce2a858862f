"""Count series from event tables, and the result store."""

"""The per-document steps over an unbounded file source."""

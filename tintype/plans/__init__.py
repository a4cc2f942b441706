"""Views over the input tables and helpers that shape plans."""

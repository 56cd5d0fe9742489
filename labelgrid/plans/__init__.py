"""Views over the driver tables, the query catalogue and whole jobs."""

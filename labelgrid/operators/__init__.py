"""DataFrame-to-DataFrame operators on sparse label tables."""

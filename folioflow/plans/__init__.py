"""Plans that end in a sink, and the catalogue of queries."""

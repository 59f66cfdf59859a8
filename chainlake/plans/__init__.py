"""Chain view of the star-schema tables and the registered queries."""

"""User-level jobs and the registered queries."""

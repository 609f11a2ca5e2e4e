"""Writers of records."""

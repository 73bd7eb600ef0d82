"""Named analyses."""

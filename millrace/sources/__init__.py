"""Files and what they are."""

"""Files that keep arriving, and the jobs that work on them."""

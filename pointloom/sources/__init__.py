"""Point-cloud sources."""

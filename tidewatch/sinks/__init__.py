"""Reports and log formats."""

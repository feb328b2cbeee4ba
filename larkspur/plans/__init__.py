"""SQL front end."""

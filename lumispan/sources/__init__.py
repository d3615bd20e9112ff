"""File formats of clouds and graphs."""

"""Small functions over names and values."""

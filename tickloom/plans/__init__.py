"""Plan building blocks that keep work per (key, chunk) instead of per key."""

"""Following runs while they write their results."""

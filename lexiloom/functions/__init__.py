"""Column expressions, fixed values and the hooks for user functions."""

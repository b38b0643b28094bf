"""Generic distributed operators."""

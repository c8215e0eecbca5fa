"""Column-level functions: normalizers, scoring rules, value slicing."""

"""Column functions: paths and versions (text), fixed-length vectors (arrays) and numpy kernels (kernels)."""

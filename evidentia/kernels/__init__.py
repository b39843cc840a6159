"""NumPy kernels for arrays that SQL does not express."""

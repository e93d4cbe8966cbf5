"""Column functions and the kernels of Arrow UDFs."""

"""Readers, generators and sinks of sparse matrices and of what is computed from them."""

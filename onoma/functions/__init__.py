"""Scalar functions: native Column builders and Arrow kernels."""

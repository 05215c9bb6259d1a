"""Scalar column functions shared by the operators."""

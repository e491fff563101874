"""Scalar functions of the two dialects as Column builders."""

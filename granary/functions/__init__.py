"""Scalar functions: ``Column -> Column``, all evaluated inside the JVM."""

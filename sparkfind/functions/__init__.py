"""Scalar functions of text preparation, vectors and display, as Spark columns where they can be."""

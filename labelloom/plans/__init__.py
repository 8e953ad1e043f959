"""Experiments assembled from the operators."""

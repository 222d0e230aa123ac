"""Readers and writers of claims, results, manifests, datasets and pages."""

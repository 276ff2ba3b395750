"""Manifests, scans, catalogs, contracts and sinks."""

"""Distributed operators: pairs, degrees, components, clustering, validation."""

"""Registered queries, grouped by subject; importing a module registers its queries."""

from trajecta.plans.queries import checks, clusters, provenance, star, territories, trajectories

__all__ = ["checks", "clusters", "provenance", "star", "territories", "trajectories"]

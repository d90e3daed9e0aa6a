"""Registered queries and the SQL each one is checked against."""

from . import base
from . import aggregates, clones, graphs, inputs, projects, scans, snapshots, structures  # noqa: F401 - register on import

base.finish()
QUERIES, ORACLES = base.QUERIES, base.ORACLES

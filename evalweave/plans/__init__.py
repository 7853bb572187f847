"""The query catalogue; importing the package registers every module's queries."""

from evalweave.plans import associations, audits, budgets, catalog, rollups, shapes, tokens  # noqa: F401

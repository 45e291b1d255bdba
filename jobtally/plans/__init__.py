"""Compositions: pipelines, the report and the registered queries."""

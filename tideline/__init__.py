"""Workflow and corpus analytics on Spark: declarative operators over task, event, document and relation tables."""

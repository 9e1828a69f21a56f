"""Dossier: document-to-record extraction, evaluation and curation on PySpark."""

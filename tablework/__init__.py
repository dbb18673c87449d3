"""tablework: a table workbench and ingestion engine expressed as Spark jobs."""

__version__ = "0.1.0"

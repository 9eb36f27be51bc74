"""tabloom: from a flat table to a scored model, as Spark jobs."""

__version__ = "0.1.0"

"""File intake, reconciliation and batch analytics as Spark jobs."""

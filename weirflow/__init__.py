"""weirflow: Spark jobs for social-signal analytics and training-data preparation."""

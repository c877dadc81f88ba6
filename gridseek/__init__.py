"""gridseek: find tables with questions, on Spark."""

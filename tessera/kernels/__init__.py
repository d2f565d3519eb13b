"""Pure functions between bytes and rows; nothing here imports Spark."""

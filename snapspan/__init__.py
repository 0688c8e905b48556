"""Player-tracking analytics as plain DataFrame operators on Spark."""

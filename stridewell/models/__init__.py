"""Small networks and their training, one Spark task for each fit."""

"""Turn grids and texts of business documents into clean shipping records with Spark."""

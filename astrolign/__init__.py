"""astrolign: celestial pattern identification as Spark DataFrame operators."""

"""srcquarry: analytics over code-intelligence data, expressed as Spark plans."""

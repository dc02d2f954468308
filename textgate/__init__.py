"""textgate: text analytics and edit verification as Spark DataFrame queries."""

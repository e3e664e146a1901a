"""ferrule: analytics over enterprise data-architecture inventories, as Spark DataFrame jobs."""

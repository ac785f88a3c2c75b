"""Analytics over two-ended link inventories, written as Spark DataFrame jobs."""

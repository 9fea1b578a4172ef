"""courtside: head-to-head match analytics expressed as Spark plans."""

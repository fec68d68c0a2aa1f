"""concordat: reconciles reported numbers with recorded evidence, as Spark jobs."""

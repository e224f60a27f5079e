"""lexigrid: lexical analytics and corpus preparation as Spark jobs."""

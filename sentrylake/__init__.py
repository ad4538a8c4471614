"""sentrylake: behavioural security analytics and corpus preparation as Spark plans."""

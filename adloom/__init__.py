"""Click-through-rate modelling over sparse categorical ad logs, as Spark jobs."""

"""claimweave: claim analytics and training-data preparation as Spark jobs."""

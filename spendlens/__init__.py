"""Ad-performance analytics as Spark jobs: DataFrame in, DataFrame out."""

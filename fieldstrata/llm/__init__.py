"""Operations that large training-data pipelines need, as Spark jobs."""

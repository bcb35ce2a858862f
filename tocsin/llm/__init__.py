"""Training-data operators: DataFrame in, DataFrame out. Nothing outside this folder imports it."""

"""Search, index and ranking operators: DataFrame in, DataFrame out."""

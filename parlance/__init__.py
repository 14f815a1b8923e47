"""Analytics over timed conversation transcripts, as Spark DataFrame plans."""

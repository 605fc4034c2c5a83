"""Recognition timelines on Spark: DataFrame operators from noisy time-stamped hits to explained segments and reports."""

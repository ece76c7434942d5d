"""Record linkage on Spark: profile, normalise, block, score, match and submit, all as DataFrame plans."""

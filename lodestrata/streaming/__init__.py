"""Region features over streams: the batch operator's aggregates, kept up to date as pixels arrive."""

"""tidewire: Spark jobs for news-text analytics (collect, clean, score, group, study)."""

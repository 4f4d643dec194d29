"""quern: a PySpark-native engine for self-improvement data pipelines over model samples."""

"""Knowledge analytics on Spark: text structuring, tagging, retrieval, graphs, metrics and quality rules as DataFrame plans."""

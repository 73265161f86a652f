"""Point-in-time customer features, labels and forecast evaluation on Spark."""

"""Purchase-prediction features, labels, models and metrics over an order-line table, on Spark."""

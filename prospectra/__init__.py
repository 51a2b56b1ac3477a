"""Spark-native engine for search orders, crawled pages and business leads."""

"""A Spark-native analytics engine for authentication and account-behaviour events."""

"""Conversation analytics and retrieval on Spark."""

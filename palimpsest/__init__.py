"""Conversation-archive analytics and corpus preparation as Spark jobs."""

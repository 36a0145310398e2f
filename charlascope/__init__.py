"""Conversation-quality analytics on Spark: find, explain and roll up the turns a chatbot could not match."""

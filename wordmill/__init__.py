"""Text, typing-session and retrieval analytics as Spark DataFrame operators."""

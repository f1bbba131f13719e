"""Part of gavel, policy moderation and corpus analytics on Spark."""

"""The replay as a Structured Streaming job."""

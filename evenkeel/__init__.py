"""evenkeel: analytics over event-level logs on the DataFrame API."""

"""Where schemas and payloads come from."""

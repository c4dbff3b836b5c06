"""The stateless row operators on a streaming DataFrame."""

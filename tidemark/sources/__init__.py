"""Tables: fixtures over test data, the versioned store, text and socket inputs."""

"""Running the stateless plans on a stream."""

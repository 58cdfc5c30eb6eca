"""DataFrame operators the metric plans are composed of."""

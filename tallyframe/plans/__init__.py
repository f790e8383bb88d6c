"""Plan shapes that hold under skew: chunked order, exact quantiles, session settings."""

"""DataFrame to DataFrame operators; every one is lazy and takes an explicit as-of time."""

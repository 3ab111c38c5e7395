"""DataFrame operators: normalize, validate, split, shape, telemetry, ledgers, synthesis."""

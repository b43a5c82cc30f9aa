"""Plan-level helpers: size-checked broadcasts, checkpoints and ordered neighbours."""

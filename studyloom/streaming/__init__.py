"""Report streams, lease timers and running curves."""

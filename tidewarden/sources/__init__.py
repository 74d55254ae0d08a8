"""Sources and sinks: message lines, manifests, versioned tables."""

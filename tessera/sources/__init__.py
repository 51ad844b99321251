"""Sources, sinks and bindings of the driver tables to the entity schemas."""

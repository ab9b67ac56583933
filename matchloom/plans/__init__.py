"""Jobs that put sources, operators and sinks together, and the registered queries."""

"""Column helpers: text, JSON payloads, hosts, zones and keys."""

"""Readers of landed payloads, warehouse tables and the driver's tables."""

"""Query registry: operators bound to the warehouse tables, with their oracle SQL."""

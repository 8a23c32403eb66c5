"""Writers: stored tables, JSON lines, CSV mirror and board snapshots."""

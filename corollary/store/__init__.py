"""Where relations live: scratch tables, snapshots, transactions."""

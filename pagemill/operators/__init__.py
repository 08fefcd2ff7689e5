"""DataFrame operators over pages, fetch logs, snapshots, hits and pings."""

"""Where graphs come from and go to: derived tables, files, snapshots, exports."""

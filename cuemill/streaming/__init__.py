"""Progress streams: state machines, newest snapshots, debounced saves, rejected duplicates."""

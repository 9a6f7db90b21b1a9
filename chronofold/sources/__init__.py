"""Tables, snapshots and their normalisation."""

"""Plans of the file-inspection engine."""

"""Sources of the file-inspection engine."""

"""Functions of the file-inspection engine."""

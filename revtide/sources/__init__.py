"""Files that tables come from and go to."""

"""Where tables come from: files with date guards, text formats, databases, records of other services."""

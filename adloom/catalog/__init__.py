"""Every operator as a runnable query, and the SQL that checks it."""

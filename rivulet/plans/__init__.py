"""From the text of a query to a DataFrame."""

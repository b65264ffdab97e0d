"""Part of ferrowick; see README.md."""

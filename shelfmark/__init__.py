"""shelfmark: file-catalog analytics as DataFrame-to-DataFrame operators on Spark."""

"""The registered queries, each with its oracle where SQL can express it."""

"""Frame stacks (position, time, depth, channel, row, column) as distributed tables, on Spark."""

"""Reading and writing tables, trees of shards, arrays, logs and lists."""

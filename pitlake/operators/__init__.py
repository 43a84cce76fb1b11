"""DataFrame -> DataFrame operators; keys, orders and column names are always arguments."""

"""Planning: schemas, cliques, join orders and trees. Nothing here touches data."""

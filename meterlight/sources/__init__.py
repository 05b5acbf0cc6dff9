"""Log sources: schemas, readers and shapes derived from them."""

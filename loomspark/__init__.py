"""Analytics over linked, messy event corpora, written as DataFrame and SQL plans."""

"""Block-sorting compression and corpus preparation as DataFrame operators."""

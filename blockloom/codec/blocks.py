"""What a coded block is: its modes, bounds and header fields. The coders are in `kernels`, the rules in `functions.columns`."""

RAW, RANKED, MIXED = 0, 1, 2
LEAST_BLOCK, MOST_BLOCK = 1 << 10, 1 << 30
#: Shortest runs that are spelled with digits, in the order of preference among equal sizes.
EXTENSIONS = (2, 3)
#: Bytes of context that a slot is hashed from, and the slot hash's multiplier (fixed values of the format).
CONTEXT, SLOT_FACTOR = 8, 0x9E3779B97F4A7C15


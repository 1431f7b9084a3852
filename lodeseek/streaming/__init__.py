"""Result event streams: emit, parse, dispatch and fold."""

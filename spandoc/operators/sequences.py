"""Token sequences: head-tail truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def head_tail(tokens: Column, max_length: int = 512, head: int = 256, tail: int = 256) -> Column:
    """First ``head`` and last ``tail`` tokens of a longer sequence, otherwise the sequence.

    If head + tail exceeds ``max_length`` the joined list is cut in its middle.
    """
    joined = F.concat(F.slice(tokens, F.lit(1), F.lit(head)),
                      F.slice(tokens, F.greatest(F.size(tokens) - tail + 1, F.lit(1)), F.lit(tail)))
    over = max(head + tail - max_length, 0)
    if over:
        keep_front = max_length - over // 2
        back = over // 2
        tail_part = F.slice(joined, F.size(joined) - back + 1, F.lit(back)) if back else F.slice(joined, 1, 0)
        joined = F.slice(F.concat(F.slice(joined, 1, keep_front), tail_part), 1, max_length)
    return F.when(F.size(tokens) <= max_length, tokens).otherwise(joined)


def padded(tokens: Column, max_length: int, pad: Column) -> Column:
    """Right-pad an array to ``max_length``."""
    return F.concat(tokens, F.array_repeat(pad, F.greatest(F.lit(max_length) - F.size(tokens), F.lit(0))))


def attention_mask(tokens: Column, max_length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(tokens)),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - F.size(tokens), F.lit(0))))

"""Column functions that match by automata (RE2, through Arrow): their time follows the text, whatever the patterns are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def holding(patterns: Sequence[str], blanked: Sequence[str] = ()) -> Callable[[Column], Column]:
    """A function of a text to the ranks, from 0, of the patterns that it holds; of a null text to none.

    Blanked: for each pattern what becomes an underscore before ('' for nothing). Classes are ASCII's, and a vertical tab is
    no white space. One pattern of all is tried first, and each by itself only on texts that hold one of them.
    """
    after = [*blanked, *[""] * (len(patterns) - len(blanked))]
    some = "|".join(f"(?:{p})" for p in [*patterns, *filter(None, after)])

    @F.arrow_udf("array<int>")
    def ranks(text: pa.Array) -> pa.Array:
        plain = text.fill_null("")
        rows = pc.match_substring_regex(plain, some).to_numpy(zero_copy_only=False).nonzero()[0]
        left = plain.take(pa.array(rows))
        one = lambda p, b: pc.match_substring_regex(pc.replace_substring_regex(left, b, "_") if b else left, p).to_numpy(zero_copy_only=False)
        held = np.stack([one(p, b) for p, b in zip(patterns, after, strict=True)], axis=1)
        sizes = np.zeros(len(plain) + 1, np.int64)
        sizes[rows + 1] = held.sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(sizes.cumsum(), pa.int32()), pa.array(held.nonzero()[1], pa.int32()))

    return ranks

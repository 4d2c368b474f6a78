"""Column functions that count words inside their rows (numpy, through Arrow, a batch of rows at a time); words need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and the number of the list that each is from."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number of each word, whatever its case, and the lower-case words by number; the words are of ASCII letters."""
    found = pc.ascii_lower(words).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _lists(row: np.ndarray, rows: int, **fields: pa.Array) -> pa.ListArray:
    """For each row the structs of its items, which are in order of rows."""
    ends = np.concatenate([[0], np.bincount(row, minlength=rows).cumsum()])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def crowded(least: int, over: float, shortest: int, skip: Sequence[str]) -> Callable[[Column], Column]:
    """A function of paragraphs (quarter, w: words) to (word, paragraphs, place) of words in at least so many of them, of
    which a share over `over` is in the first quarter or the last; words are of at least so many letters and not skipped."""

    @F.arrow_udf("array<struct<word:string,paragraphs:bigint,place:string>>")
    def found(paragraphs: pa.Array) -> pa.Array:
        each, doc = _flat(paragraphs)
        quarter = pc.struct_field(each, "quarter").to_numpy(zero_copy_only=False)
        words, para = _flat(pc.struct_field(each, "w"))
        code, known = _coded(words)
        asked = pc.and_(pc.greater_equal(pc.utf8_length(known), shortest), pc.invert(pc.is_in(known, pa.array(skip, pa.string())))).to_numpy(zero_copy_only=False)
        kept, size = asked[code], max(len(known), 1)
        once = np.unique(para[kept] * size + code[kept])
        para, code = once // size, once % size
        each_word, at, n = np.unique(doc[para] * size + code, return_inverse=True, return_counts=True)
        first, last = (np.bincount(at, quarter[para] == q, len(n)) / n > over for q in (0, 3))
        good = np.flatnonzero((n >= least) & (first | last))
        place = pa.array(np.where(first[good], "first", "last"), pa.string())
        return _lists(each_word[good] // size, len(paragraphs), word=known.take(pa.array(each_word[good] % size)), paragraphs=pa.array(n[good], pa.int64()), place=place)

    return found


def repeated(sizes: Sequence[int], least: int) -> Callable[[Column], Column]:
    """A function of words to (gram, n, size) of the phrases of so many words that come at least so often.

    A phrase is looked at only where both phrases of one word less in it come so often; no other is ever made into text.
    """

    @F.arrow_udf("array<struct<gram:string,n:bigint,size:int>>")
    def found(lists: pa.Array) -> pa.Array:
        words, doc = _flat(lists)
        code, known = _coded(words)
        vocabulary = max(len(known), 1)
        at, key, longer, hits = np.arange(len(code)), doc * vocabulary + code, 1, []
        while len(at):
            _, first, gram, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if longer in sizes:
                hits += [(doc[at[first[k]]], at[first[k]], n[k], longer) for k in np.flatnonzero(n >= least)]
            often = n[gram] >= least
            at, gram = at[often], gram[often]
            beside = np.flatnonzero((np.diff(at) == 1) & (doc[at[:-1]] == doc[at[1:]])) if longer < max(sizes) else []
            key, at, longer = gram[beside] * vocabulary + code[at[beside] + longer], at[beside], longer + 1
        hits.sort()
        texts = [" ".join(known.take(pa.array(code[p : p + size])).to_pylist()) for _, p, _, size in hits]
        row = np.array([h[0] for h in hits], np.int64)
        return _lists(row, len(lists), gram=pa.array(texts, pa.string()), n=pa.array([h[2] for h in hits], pa.int64()), size=pa.array([h[3] for h in hits], pa.int32()))

    return found


def counted(fewer: int) -> Callable[[Column], Column]:
    """A function of words to (word, n) of those, in lower case, that come fewer than so many times."""

    @F.arrow_udf("array<struct<word:string,n:bigint>>")
    def found(lists: pa.Array) -> pa.Array:
        words, doc = _flat(lists)
        code, known = _coded(words)
        size = max(len(known), 1)
        each, n = np.unique(doc * size + code, return_counts=True)
        each, n = each[n < fewer], n[n < fewer]
        return _lists(each // size, len(lists), word=known.take(pa.array(each % size)), n=pa.array(n, pa.int64()))

    return found

"""Texts cut into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def chunk_bounds(lengths: np.ndarray, most: int, back: int) -> list[tuple[int, int]]:
    """Stretches of words: as many as fit into ``most`` characters, one at least, then back over ``back`` characters."""
    upto = np.concatenate(([0], np.cumsum(lengths + 1)))
    n, i, out = len(lengths), 0, []
    while i < n:
        j = max(int(np.searchsorted(upto, upto[i] + most + 1, side="right")) - 1, i + 1)
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, int(np.searchsorted(upto, upto[j] - back, side="right")) - 1)
    return out


def chunks(docs: DataFrame, tokens: int = 512, overlap: int = 64, single: int = 512) -> DataFrame:
    """id, chunk_index, chunk, at about four characters a token.

    A text of at most ``single`` tokens is one chunk, as it stands but for blanks at its ends.  Longer ones are words
    packed greedily, joined by one blank, with about ``overlap`` tokens repeated at the seams.  Texts of blanks give none.
    """
    most, back = tokens * 4, min(overlap, tokens - 1) * 4

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["content"], strict=True):
                text = (text or "").strip()
                if 0 < len(text) <= single * 4:
                    out.append((key, 0, text))
                elif text:
                    own = text.split()
                    lengths = np.fromiter(map(len, own), np.int64, len(own))
                    out += [(key, n, " ".join(own[i:j])) for n, (i, j) in enumerate(chunk_bounds(lengths, most, back))]
            yield pd.DataFrame(out, columns=["id", "chunk_index", "chunk"])

    return docs.select("id", "content").mapInPandas(cut, "id long, chunk_index int, chunk string")

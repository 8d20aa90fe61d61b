"""Token counts of whole texts under a byte-level vocabulary.

Texts up to ``CHUNK`` characters are encoded at once. A longer one is encoded as chunks that
overlap; two neighbours are spliced at a boundary that both have in their overlap and that is
proven: a blank after a character that is no white space always starts a new word in this
vocabulary's splitting, whatever stands around it, and special tokens hold no blanks. Where
an overlap holds no such boundary it is doubled, until the two chunks are one.

Latin text runs on the rank engine, which gives the same ids; texts with other characters or
special tokens run on the ``tokenizers`` library itself, whose default turns special strings
in a text into their tokens.

Defined results: null and empty texts have no bytes and no tokens; repeated rows are counted
each; an empty table gives no rows; a null ``doc_id`` is kept; extra columns play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm import bpe
from notelens.llm.scratch import sliced

CHUNK = 1 << 16
OVERLAP = 1 << 9
LIMIT = 512


class Counter:
    """Token ends of texts, in characters; ``ranks`` is the same vocabulary's rank file, if there is one."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.engine = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.engine = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.sizes = np.zeros(max(table.values()) + 1, np.int64)
            self.sizes[list(table.values())] = [len(t) for t in table]

    def _usual(self, text: str) -> bool:
        return self.engine is not None and not bpe.UNUSUAL.search(text)

    def ends(self, text: str) -> np.ndarray:
        if self._usual(text):
            ends = np.cumsum(self.sizes[self.engine.encode_to_numpy(text, disallowed_special=())])
            if len(raw := text.encode()) == len(text):
                return ends
            first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            return np.concatenate([[0], np.cumsum(first)])[ends]
        return np.array([e for _, e in self.library.encode(text, add_special_tokens=False).offsets], np.int64)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) > chunk:
            return count_spliced(text, self.ends, chunk, overlap)
        if self._usual(text):
            return len(self.engine.encode_to_numpy(text, disallowed_special=()))
        return len(self.library.encode(text, add_special_tokens=False).ids)


def proven(text: str, at: int) -> bool:
    """Whether every encoding has a word start at ``at``."""
    return 0 < at < len(text) and text[at] == " " and not text[at - 1].isspace()


def count_spliced(text: str, ends_of: Callable[[str], np.ndarray], chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from chunks, each beginning ``overlap`` or more before the last one's end."""
    total, start, stop = 0, 0, chunk
    ends = ends_of(text[start:stop])
    held = 0  # tokens of this chunk that the chunk before has counted
    while stop < len(text):
        reach = overlap
        while True:
            begin = max(start, stop - reach)
            after = min(len(text), begin + max(chunk, 2 * reach))
            following = ends_of(text[begin:after])
            both = np.intersect1d(ends + start, following + begin)
            meet = next((int(p) for p in both[::-1] if begin < p <= stop and proven(text, int(p))), None)
            if meet is not None and np.searchsorted(ends, meet - start, side="right") >= held:
                total += int(np.searchsorted(ends, meet - start, side="right")) - held
                held = int(np.searchsorted(following, meet - begin, side="right"))
                start, stop, ends = begin, after, following
                break
            if begin == start:  # no boundary in the whole chunk: both become one
                grown = ends_of(text[start:after])
                stop, ends = after, grown
                break
            reach *= 2
    return total + len(ends) - held


def count_tokens(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, ranks, pattern)
        for batch in sliced(batches):
            texts = batch.column("text").fill_null("")
            tokens = np.array([counter.count(t) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.binary_length(texts.cast(pa.binary())), pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

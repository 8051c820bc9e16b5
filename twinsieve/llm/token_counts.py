"""Token counts of byte-pair models, without the tokens (operator 8).

A text starts as one symbol per character, or one per byte where the model knows
no such character. A heap holds the adjacent pairs that the vocabulary can merge, by
rank and place; symbols are a linked list. The lowest pair is popped and merged until
none is left: the count is the number of initial symbols less the number of merges.

A merged piece is in the vocabulary, so two neighbouring characters that stand together
in no piece are never merged. Where no piece has a blank after another character, a
text may be cut before each run of blanks, and always around characters of no longer
piece. The chunks are counted apart: same merges, and chunks repeat so often that most
counts come from a bounded memo, which a worker keeps from task to task.

Null counts as empty; an empty text has no tokens. Very long chunks take n log n.
"""

import heapq
import re
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import with_columns

BLANK = "▁"  # how the model writes a space
MEMO_ENTRIES = 400_000
MEMO_CHUNK = 64  # longer chunks are not kept


class PairCounter:
    """Counts as the BPE model at `path` would, with byte fallback and no extra symbols."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [
            (-model.get_score(i), model.id_to_piece(i))
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        ]
        self.rank = {piece: rank for rank, piece in pieces}
        # Either every space is kept as it is and one is put in front, or we don't count.
        probe = model.encode("a  b ", out_type=str)
        if "".join(probe) != f"{BLANK}a{BLANK * 2}b{BLANK}":
            raise ValueError("only models that keep blanks and put one in front are supported")
        joined = any(a != BLANK and b == BLANK for p in self.rank for a, b in zip(p, p[1:]))
        within = {c for p in self.rank if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in within)
        start = "" if joined else BLANK
        self.chunks = re.compile(f"{BLANK}*[^{start}{alone}]+|{BLANK}+|[{alone}]", re.DOTALL)
        self.memo: dict[str, int] = {}

    def merged(self, symbols: str) -> int:
        """Tokens of a chunk, by heap and linked list."""
        rank, n = self.rank, len(symbols)
        count = sum(1 if c in rank else len(c.encode()) for c in symbols)
        if n < 2:
            return count
        text = list(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [
            (r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = text[i]
            j = right[i]
            # Outdated if either symbol has been merged since.
            if not a or j < 0 or len(a) + len(text[j]) != size:
                continue
            a = text[i] = a + text[j]
            text[j] = ""
            k = right[i] = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if (r := rank.get(a + text[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(text[k])))
            h = left[i]
            if h >= 0 and (r := rank.get(text[h] + a)) is not None:
                heapq.heappush(heap, (r, h, len(text[h]) + size))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for chunk in self.chunks.findall(BLANK + text.replace(" ", BLANK)):
            n = memo.get(chunk)
            if n is None:
                n = self.merged(chunk)
                if len(chunk) <= MEMO_CHUNK:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[chunk] = n
            total += n
        return total


@cache
def pair_counter(path: str) -> PairCounter:
    return PairCounter(path)


def token_counts(docs: DataFrame, model: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text; other columns pass through as they are.

    `model` is the path of a sentencepiece BPE model that executors can read. The work
    is map-side: no shuffle, one text in memory at a time.
    """


    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counter = pair_counter(model)
        return pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())

    return with_columns(docs, {name: count(docs[text])})

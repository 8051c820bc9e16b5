"""Numbers of a text that quality operators work with, for many texts at once."""

import numpy as np
import pyarrow as pa

from twinsieve.llm.textbatch import Texts, distinct_by_text, mix, order_by_text, seeded

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_U = np.uint64


def _flags(*groups: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(b"".join(groups))] = True
    return table


_IS_SYMBOL = _flags(SYMBOLS)
_IS_UPPER = _flags(bytes(range(65, 91)))
_IS_LOWER = _flags(bytes(range(97, 123)))
_IS_DIGIT = _flags(bytes(range(48, 58)))
_IS_PUNCTUATION = _flags(bytes(range(33, 48)), bytes(range(58, 65)), bytes(range(91, 97)), bytes(range(123, 127)))
_IS_CODE_POINT = np.ones(256, bool)
_IS_CODE_POINT[0x80:0xC0] = False  # bytes that go on with a character


class Stats:
    """Counts per text, as arrays; nothing crosses from one text to the next."""

    def __init__(self, texts: pa.Array):
        t = self.texts = Texts(texts)
        w = self.words = t.words()
        self.hashes = w.hashes()
        self.n_words = w.count
        points = np.concatenate(([0], np.cumsum(_IS_CODE_POINT[t.raw])))
        self.word_chars = self._sum(points[w.end] - points[w.start])
        self.n_symbols = t.per_text(_IS_SYMBOL[t.raw])
        self._lines()
        self._repeats()

    def _sum(self, per_word: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(per_word)))
        return total[self.words.first[1:]] - total[self.words.first[:-1]]

    def _lines(self) -> None:
        t, w = self.texts, self.words
        end = np.flatnonzero(t.raw == 10)
        start = np.concatenate(([0], end[:-1] + 1)).astype(np.int64)
        text = np.searchsorted(t.end, end)
        first_word = np.searchsorted(w.start, start)
        full = first_word < np.searchsorted(w.start, end)
        text, start, end = text[full], start[full], end[full]
        different = distinct_by_text(text, t.span_hashes(start, end))[0]
        self.n_lines = np.bincount(text, minlength=t.n)
        self.n_dup_lines = self.n_lines - np.bincount(different, minlength=t.n)

    def _repeats(self) -> None:
        """Words inside 5-word windows that their text has twice or more."""
        w, n = self.words, len(self.words.text) - WINDOW + 1
        covered = np.zeros(len(w.text) + 1, np.int64)
        inside = np.flatnonzero(w.text[:n] == w.text[WINDOW - 1 :]) if n > 0 else ()
        if len(inside):
            rolled = sum(seeded(self.hashes[i : i + n], i) for i in range(WINDOW))
            text, value = w.text[inside], mix(rolled[inside])
            order = order_by_text(text, value)
            t, v = text[order], value[order]
            again = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
            repeated = np.concatenate((again, [False])) | np.concatenate(([False], again))
            at = inside[order[repeated]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
        self.n_repeat_words = self._sum((np.cumsum(covered)[:-1] > 0).astype(np.int64))

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def features(self) -> np.ndarray:
        """One row per text, one column per name in FEATURES."""
        t, w = self.texts, self.words
        n_bytes = np.maximum(t.end - t.begin, 1)
        n = np.maximum(self.n_words, 1)
        raw = t.raw
        same = np.zeros(len(w.text), np.int64)
        if len(same):
            same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (w.text[1:] == w.text[:-1])
        text, _, times = distinct_by_text(w.text, self.hashes)
        most = np.zeros(t.n, np.int64)
        np.maximum.at(most, text, times)
        letters = np.concatenate(([0], np.cumsum((_IS_LOWER | _IS_UPPER)[raw] | (raw > 127))))
        bare = self._sum((letters[w.end] == letters[w.start]).astype(np.int64))
        length = w.end - w.start
        columns = [
            np.log1p(self.n_words),
            self.word_chars / n,
            self.n_symbols / n,
            self.n_dup_lines / np.maximum(self.n_lines, 1),
            self.n_repeat_words / n,
            np.bincount(text, minlength=t.n) / n,
            t.per_text(_IS_UPPER[raw]) / n_bytes,
            t.per_text(_IS_DIGIT[raw]) / n_bytes,
            t.per_text(_IS_PUNCTUATION[raw]) / n,
            self._sum(same) / n,
            t.per_text(raw > 127) / n_bytes,
            self.n_words / np.maximum(self.n_lines, 1),
            most / n,
            bare / n,
            self._sum((length > 15).astype(np.int64)) / n,
        ]
        return np.stack(columns, axis=1).astype(np.float64)


FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper",
    "digits", "punctuation", "doubled", "non_ascii", "line_words", "top_word", "bare_words",
    "long_words",
)

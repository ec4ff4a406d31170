"""Token counts of a unigram vocabulary without ids: Viterbi that carries the best score and the number of pieces.

Aho-Corasick lists the vocabulary entries that end at each character, longest first. The best score of an end is kept
with the count of pieces on its path; of equal scores, the entry that starts first stays, as in the tokenizers
library. A character without an entry of its own counts as unknown, at 10 below the lowest score, and successive
unknown ones are one piece. Text is cut into words; each word is scored with a leading mark for the space before it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import column, keyed, parquet, slices

NAME, SPACE, UNKNOWN_PENALTY = "piece_bpe_32k.model", "▁", 10.0
MOST_WORDS, LONGEST_KEPT = 600_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file. Its scores are ranks; the r-th piece gets -ln(r + 2) as its log
    probability (Zipf's law), and the unknown piece comes first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [("<unk>", 0.0), *((p, -math.log(r + 2)) for r, p in enumerate(dict.fromkeys(pieces)))]


class Counter(dict):
    """Word (bytes) -> number of pieces."""

    def __init__(self, entries: list[tuple[str, float]]):
        self.unknown = min(s for _, s in entries) - UNKNOWN_PENALTY
        self.pieces = ahocorasick.Automaton()
        for piece, score in entries[1:]:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in entries[1:] if len(p) == 1}

    def __missing__(self, word: bytes) -> int:
        n = self.count(SPACE + word.decode())
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = n
        return n

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        none = -math.inf
        score, pieces, open_ = [0.0] + [none] * len(text), [0] * (len(text) + 1), [False] * (len(text) + 1)
        reached = 0

        def close(upto: int) -> None:
            # Unknown characters: they start last of all that end at their place.
            for e in range(reached + 1, upto + 1):
                if text[e - 1] not in self.single:
                    s = score[e - 1] + self.unknown
                    if s > score[e]:
                        score[e], pieces[e], open_[e] = s, pieces[e - 1] + (not open_[e - 1]), True

        for end, (n, s) in self.pieces.iter(text):
            if end > reached:
                close(end)
                reached = end
            at = end + 1 - n
            s += score[at]
            if s > score[end + 1]:
                score[end + 1], pieces[end + 1], open_[end + 1] = s, pieces[at] + 1, False
        close(len(text))
        return score[-1], pieces[-1]

    def count(self, text: str) -> int:
        return self.best(text)[1]


@functools.cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


SCHEMA = "doc_id long, n_words long, n_tokens long"


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row; a null or empty text, or one of separators only, has 0 of both.
    Repeated rows are counted each; keys are passed on, of any type and null too; an empty table gives no rows; other columns are not looked at."""
    if path is None:
        from corpusloom.llm.bpe import default_path

        path = default_path(NAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            keys, texts = column(batch, "k"), column(batch, "t").fill_null("")
            for lo, hi in slices(texts):
                words = [x.as_buffer().to_pybytes().split() for x in texts[lo:hi]]
                yield pa.record_batch([keys[lo:hi], pa.array(map(len, words), pa.int64()), pa.array([sum(map(own.__getitem__, w)) for w in words], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, keyed(SCHEMA, df, key))


def op4_token_counts(spark, sf_dir):
    return count_tokens(parquet(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}

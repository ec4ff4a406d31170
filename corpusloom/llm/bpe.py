"""Exact BPE by dynamic programming over prefixes.

For every prefix of a piece, the last token of its encoding is unique. It is found among the vocabulary entries that
are suffixes of the prefix (an automaton over the vocabulary with suffix links lists them, longest first): it is the
one that may stand after the last token of the rest. Two tokens may stand side by side if no merge across their
border would have come before the merges inside them. Back-pointers from the end give the ids.

The vocabulary file is one of the tokenizers library: BPE with word ends, a normalizer (NFC, white space, lower case)
and a splitting pattern. Distinct words are encoded once per worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.common import column, keyed, parquet, slices

NAME = "word_bpe_49k.json"
#: Entries of the caches; a full one starts anew. Longer words are not kept.
MOST_WORDS, MOST_PAIRS, LONGEST_KEPT = 700_000, 1_000_000, 48
_END = "\n"  # stands for the word end inside the automaton; no byte character is one
_NEVER = 1 << 60


def default_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character for each byte of byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Merge ranks, and of each token the outer parts that meet a neighbour: nodes from the single character up to
    the token, each with the rank of the merge that ends it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank: dict[int, int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[self.joined(a, b)]
            if whole in made:
                raise ValueError(f"token {whole} is made by two merges")
            made[whole] = (left, right, rank)
            self.rank[left << 20 | right] = rank
        self.right: dict[int, tuple[list[int], list[int]]] = {}
        self.left: dict[int, tuple[list[int], list[int]]] = {}
        self.sound: set[int] = set()
        self.pairs: dict[int, bool] = {}
        for token in vocab.values():
            if token not in made:
                self._single(token)
        for token, (left, right, rank) in sorted(made.items(), key=lambda x: x[1][2]):
            for spines, part in ((self.right, right), (self.left, left)):
                nodes, ends = spines[part]
                spines[token] = ([*nodes, token], [*ends[:-1], rank, _NEVER])
            if left in self.sound and right in self.sound and self._apart(left, right, rank):
                self.sound.add(token)

    @staticmethod
    def joined(a: str, b: str) -> str:
        return a + b

    def _single(self, token: int) -> None:
        self.right[token] = self.left[token] = ([token], [_NEVER])
        self.sound.add(token)

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge across the border comes before `until`. Of equal merges, the left one comes first."""
        (xs, x_ends), (ys, y_ends) = self.right[a], self.left[b]
        i, j, rank = 0, 0, self.rank
        while True:
            m = rank.get(xs[i] << 20 | ys[j])
            x_end, y_end = min(x_ends[i], until), min(y_ends[j], until)
            if m is not None and m < x_end and (m <= y_end if y_end < until else m < y_end):
                return False
            if x_end >= until and y_end >= until:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def apart(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b)
        return found


class _Words(dict):
    """Word -> its ids as unsigned 16-bit bytes."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str, own: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if max(self.text_of) >= 1 << 16:
            raise ValueError("ids over 16 bits")
        if own:
            self._build(vocab, model)
        self.characters = byte_characters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.path = path
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.words = _Words(self._word)
        self.known: dict[str, bytes] = _Words(self._piece)

    def _build(self, vocab: dict[str, int], model: dict) -> None:
        suffix = model["end_of_word_suffix"]
        self.merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.length: dict[int, int] = {}
        self.tokens = ahocorasick.Automaton()
        for text, token in vocab.items():
            own = text[: -len(suffix)] + _END if text.endswith(suffix) else text
            if token in self.merges.sound:
                self.length[token] = len(own)
                self.tokens.add_word(own, (token, len(own)))
        self.tokens.make_automaton()

    def mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([self.characters[b] for b in piece.encode()])

    def ids_of(self, piece: str) -> list[int]:
        """The ids of one piece of the splitting pattern."""
        return self._ids(self.mapped(piece))

    def _ids(self, text: str) -> list[int]:
        text += _END
        apart, last = self.merges.apart, [-1] * (len(text) + 1)
        for end, (token, n) in self.tokens.iter(text):
            if last[end + 1] < 0:
                at = end + 1 - n
                if at == 0 or apart(last[at], token):
                    last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= self.length[last[at]]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        return array("H", self.ids_of(piece)).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            return self.known[word]
        return b"".join([self.known[p] for p in self.pieces(word)])

    @functools.cached_property
    def library(self):
        """For the classes of characters on which versions of Unicode differ: the library's own splitting."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif _RARE(text):
            text = self.library.normalizer.normalize_str(text)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
            return b"".join([array("H", self._ids(p)).tobytes() for p, _ in pieces])
        else:
            text = unicodedata.normalize("NFC", text)
            # Lower case goes by single characters, without the rule for a final sigma.
            text = text.replace("Σ", "σ").lower()
        if _ODD_SPACE(text):
            return b"".join([self.known[p] for p in self.pieces(_SPACE.sub(" ", text))])
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 16-bit numbers, little-endian; added tokens in the text are taken as such."""
        if "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join([self._plain(p) if i % 2 == 0 else array("H", [self.added[p]]).tobytes() for i, p in enumerate(parts)])

    def decode(self, ids: array) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


#: Where str.split() and the pattern's \s differ.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
_SPACE = regex.compile(r"\s+")
#: What is not in blocks that have been full for long: Latin, Cyrillic, general punctuation, kana, unified ideographs.
_RARE = re.compile("[^\\x00-\u024f\u0400-\u0481\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\u00a0]").search


@functools.cache
def tokenizer(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


class LibraryIds(WordBpe):
    """The same ids where only ids count: each distinct piece goes through the library's own model."""

    def ids_of(self, piece: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(self.mapped(piece))]

    def _ids(self, text: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(text)]


@functools.cache
def id_maker(path: str) -> WordBpe:
    """One per worker process."""
    return LibraryIds(path, own=False)


SCHEMA = "doc_id long, ids binary, decoded string"


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, decode: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) for every row: ids as little-endian unsigned 32-bit numbers, and the text they give.

    A null text is an empty one and has no ids. Keys are passed on as they are, of any type and null too; repeated rows are encoded each;
    an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = column(batch, "k"), column(batch, "t").fill_null("")
            for lo, hi in slices(texts):
                ids, decoded = [], []
                for x in texts[lo:hi].to_pylist():
                    own = array("H", bpe.encode(x))
                    ids.append(array("I", own).tobytes())
                    decoded.append(bpe.decode(own) if decode else None)
                yield pa.record_batch([keys[lo:hi], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, keyed(SCHEMA, df, key))




def op7_bpe(spark, sf_dir):
    from pyspark.sql import functions as F

    out = encode_texts(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}

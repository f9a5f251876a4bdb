"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces that end at each character of a
word; dynamic programming carries, for each place, the best score and the number
of tokens on the path that has it.  No path is kept and no token is made.

The rules are those of the public tokenizers library (a unigram model behind
metaspace splitting): a space becomes ``▁``, one is put before the text, and a
word begins at each ``▁``; scores add up from the left in double precision; of
paths with equal scores the one whose last piece is longest wins; a character
that is no piece by itself may stand as unknown, 10 below the lowest score of
the vocabulary; unknown characters count their bytes if the vocabulary has byte
pieces, and else one token for each run of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import slices

SPACE = "▁"
#: What an unknown character scores below the lowest piece (fixed value).
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker holds at most, and the longest of them.
HELD, LONGEST = 1_000_000, 64


class UnigramCounter:
    """Counts tokens; ``pieces`` are the (piece, score) that may match text, ``has_bytes`` says that unknown characters fall back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], has_bytes: bool):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            self.find.add_word(piece, (len(piece), float(score)))
        if pieces:
            self.find.make_automaton()
        self.empty = not pieces
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.has_bytes = has_bytes
        self.held: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens on the best path through a word."""
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, top, tokens, single = 0, None, 0, False

        def close(at: int) -> None:
            """The place after character ``at`` is done: an unknown character may still beat its pieces."""
            if not single:
                score = best[at] + self.unknown
                if top is None or score > top:
                    more = len(word[at].encode("utf-8", "replace")) if self.has_bytes else int(not unknown[at])
                    best[at + 1], count[at + 1], unknown[at + 1] = score, count[at] + more, True
                    return
            best[at + 1], count[at + 1] = top, tokens

        for end, (length, score) in () if self.empty else self.find.iter(word):  # longest first at each end
            while at < end:
                close(at)
                at, top, single = at + 1, None, False
            score += best[end + 1 - length]
            if top is None or score > top:
                top, tokens = score, count[end + 1 - length] + 1
            single |= length == 1
        while at < n:
            close(at)
            at, top, single = at + 1, None, False
        return count[n]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        parts = []
        wanted: set[str] = set()
        for t in texts:
            words = t.replace(" ", SPACE).removeprefix(SPACE).split(SPACE) if t else []
            wanted.update(words)
            parts.append(words)
        if len(self.held) + len(wanted) > HELD:
            self.held = {}
        held = self.held
        for w in wanted:
            if w not in held:
                held[w] = self.word(SPACE + w)
        out = [sum(map(held.__getitem__, words)) for words in parts]
        for w in wanted:
            if len(w) > LONGEST:
                del held[w]
        return out


_loaded: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """The counter of a piece file's vocabulary: its pieces and their scores; control and unknown pieces never match text."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _loaded[path] = UnigramCounter(pieces, any(sp.is_byte(i) for i in ids))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_tokens of every whole text under the vocabulary in ``path``.

    Null and empty texts have no tokens; repeated rows are counted each, null
    ids stay null, and an empty table gives no rows.  Other columns are ignored.
    No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, "text_"):
            n = c.counts([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(n, np.int64))], [id_col, "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` as text_").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def op6_viterbi_token_counts(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

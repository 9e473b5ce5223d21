"""Token counts under a unigram vocabulary, without making the tokens.

A word with the mark ``\\u2581`` before it is cut into the pieces whose scores add
up to most (Viterbi).  An Aho-Corasick automaton enumerates the pieces that end
at each byte, longest first; only the best score and its number of pieces are
carried.  Ties follow the ``tokenizers`` library: among equal scores the piece
that starts first wins, and a character without a piece of its own costs the
unknown score and counts one for each of its bytes (byte fallback).

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Distinct words of a slice are counted
once, all together: the automaton steps through the n-th byte of every word.
Long words (scripts without spaces) lie one after the other; there the automaton
steps through the n-th byte of every stretch, after as many bytes before it as
the longest piece has, which put it into the right state, and the scores that
the longest piece can reach back to are carried from character to character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textkit import ranges, slices
from barloom.llm.vocabulary import SLICE, WordCache

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Words of more bytes are counted by stretches of so many bytes, in blocks.
LONG, STRETCH, BLOCK = 128, 1 << 10, 1 << 18


class Automaton:
    """Aho-Corasick automaton over the bytes of pieces, with scores."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        children: list[dict[int, int]] = [{}]
        depth, self_score = [0], {}
        for piece, score in pieces:
            state = 0
            for byte in piece.encode():
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    depth.append(depth[state] + 1)
                state = children[state][byte]
            if state:
                self_score[state] = score
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        self.length = np.array(depth, np.int32)
        self.score = np.zeros(n)
        self.ends = np.zeros(n, bool)
        for state, score in self_score.items():
            self.score[state], self.ends[state] = score, True
        fail = np.zeros(n, np.int32)
        self.output = np.zeros(n, np.int32)  # the longest piece that ends here
        self.shorter = np.zeros(n, np.int32)  # the next shorter one
        for byte, child in children[0].items():
            self.step[0, byte] = child
        queue = [0]
        for state in queue:
            back = fail[state]
            if state:
                row = self.step[back].copy()
                for byte, child in children[state].items():
                    fail[child] = row[byte]
                    row[byte] = child
                self.step[state] = row
                self.shorter[state] = self.output[back]
                self.output[state] = state if self.ends[state] else self.output[back]
            queue.extend(children[state].values())
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.longest = int(self.length[self.ends].max(initial=1))

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of the best cut of each word ``data[start:start+length]``."""
        out = np.zeros(len(starts), np.int64)
        # words of like length together, so that short ones don't wait for long
        for lo, hi in ((1, 8), (9, 16), (17, 32), (33, LONG)):
            some = np.flatnonzero((lengths >= lo) & (lengths <= hi))
            for a in range(0, len(some), 1 << 16):
                rows = some[a : a + (1 << 16)]
                rows = rows[np.argsort(-lengths[rows], kind="stable")]
                out[rows] = self._run(data, starts[rows], lengths[rows])
        some = np.flatnonzero(lengths > LONG)
        if len(some):
            m = len(MARK)
            size = lengths[some] + m
            begins = np.cumsum(size) - size
            stream = np.empty(int(size.sum()), np.uint8)
            for i, byte in enumerate(MARK):
                stream[begins + i] = byte
            stream[ranges(begins + m, size - m)] = data[ranges(starts[some], size - m)]
            out[some] = self._long(stream, begins)
        return out

    def _states(self, stream: np.ndarray, fresh: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """States after each byte lo..hi-1; words begin where ``fresh``."""
        rows = np.arange(lo, hi, STRETCH)
        out = np.zeros((len(rows), STRETCH), np.int32)
        state = np.zeros(len(rows), np.int32)
        for j in range(-self.longest, STRETCH):
            at = np.clip(rows + j, 0, len(stream) - 1)
            state = self.step[np.where(fresh[at], 0, state), stream[at]]
            if j >= 0:
                out[:, j] = state
        return out.ravel()[: hi - lo]

    def _long(self, stream: np.ndarray, begins: np.ndarray) -> list[int]:
        """Pieces of the best cuts of words that fill ``stream`` from ``begins``."""
        fresh = np.zeros(len(stream) + 1, bool)
        fresh[begins] = fresh[-1] = True
        mask = (1 << self.longest.bit_length() + 1) - 1  # scores are kept in a ring
        best, pieces = [0.0] * (mask + 1), [0] * (mask + 1)
        unknown, out, start = self.unknown, [], 0
        for lo in range(0, len(stream), BLOCK):
            hi = min(lo + BLOCK, len(stream))
            state = self._states(stream, fresh, lo, hi)
            piece, at, found = self.output[state], np.arange(hi - lo), []
            while True:
                at, piece = at[piece > 0], piece[piece > 0]
                if not len(at):
                    break
                found.append((at, self.length[piece], self.score[piece]))
                piece = self.shorter[piece]
            where = np.concatenate([x for x, _, _ in found] or [np.zeros(0, np.int64)])
            order = np.argsort(where, kind="stable")  # longest first at each place
            size = np.concatenate([x for _, x, _ in found] or [np.zeros(0, np.int32)])[order].tolist()
            score = np.concatenate([x for _, _, x in found] or [np.zeros(0)])[order].tolist()
            after = stream[lo + 1 : hi + 1]
            last = fresh[lo + 1 : hi + 1].copy()  # of its character, then of its word
            words = last.copy()
            last[: len(after)] |= (after & 0xC0) != 0x80
            last = np.flatnonzero(last)
            a, z = np.searchsorted(where[order], last, "left").tolist(), np.searchsorted(where[order], last, "right").tolist()
            for p, x, y, word in zip((last + lo + 1).tolist(), a, z, words[last].tolist()):
                top, cut, width, single = 0.0, 0, p - start, False
                for i in range(x, y):
                    n = size[i]
                    s = best[p - n & mask] + score[i]
                    if i == x or s > top:
                        top, cut = s, pieces[p - n & mask] + 1
                    single = single or n == width
                if not single:
                    s = best[start & mask] + unknown
                    if x == y or s > top:
                        top, cut = s, pieces[start & mask] + width
                start = p
                if word:
                    out.append(cut)
                    top, cut = 0.0, 0
                best[p & mask], pieces[p & mask] = top, cut
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``lengths`` falls, so the words that go on are always the first."""
        m, most = len(MARK), int(lengths[0])
        best = np.zeros((most + m + 1, len(starts)))
        pieces = np.zeros((most + m + 1, len(starts)), np.int64)
        state = np.zeros(len(starts), np.int32)
        begin = np.zeros(len(starts), np.int64)  # where the last character starts
        for p in range(1, most + m + 1):
            n = len(starts) if p <= m else int(np.searchsorted(-lengths, -(p - m), "right"))
            byte = np.full(n, MARK[p - 1]) if p <= m else data[starts[:n] + p - 1 - m]
            state = self.step[state[:n], byte]
            begin = np.where((byte & 0xC0) != 0x80, p - 1, begin[:n])
            top, cut, found = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
            single = np.zeros(n, bool)
            rows, piece = np.arange(n), self.output[state]
            while True:
                rows, piece = rows[piece > 0], piece[piece > 0]
                if not len(rows):
                    break
                at = p - self.length[piece]
                score = best[at, rows] + self.score[piece]
                better = ~found[rows] | (score > top[rows])
                r = rows[better]
                top[r], cut[r], found[r] = score[better], pieces[at[better], r] + 1, True
                single[rows[at == begin[rows]]] = True
                piece = self.shorter[piece]
            # at the end of a character without a piece of its own; a byte inside
            # a character is overwritten by none and read by none
            score = best[begin, np.arange(n)] + self.unknown
            better = ~single & (~found | (score > top))
            top = np.where(better, score, top)
            cut = np.where(better, pieces[begin, np.arange(n)] + p - begin, cut)
            best[p, :n], pieces[p, :n] = top, cut
        return pieces[lengths + m, np.arange(len(starts))]


@lru_cache(maxsize=1)
def automaton(vocabulary: str) -> Automaton:
    """From a sentencepiece model file: its pieces and scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return Automaton([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])


@lru_cache(maxsize=1)
def counted(vocabulary: str) -> WordCache:
    """Counts of words that earlier tasks of this worker met."""
    return WordCache()


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of whole texts.

    Null and empty texts have no tokens; rows with a null doc_id and repeated
    rows are counted like others; other columns are left out.  The vocabulary file is read on each worker.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, cache = automaton(vocabulary), counted(vocabulary)
        for b in batches:
            for lo, hi, part in slices(b.column(1), SLICE):
                per_word = cache.get(part.hashes(), part.hashes(1), lambda i: cutter.counts(part.data, part.starts[i], part.ends[i] - part.starts[i]))
                total = np.concatenate([[0], np.cumsum(per_word)])
                tokens = total[part.first[1:]] - total[part.first[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(part.counts.astype(np.int64)), pa.array(tokens.astype(np.int64))],
                    names=["doc_id", "n_words", "n_tokens"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(job, "doc_id long, n_words long, n_tokens long")

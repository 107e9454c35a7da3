"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets a leading blank and is cut into marked words: a run of blanks with the word that follows. No piece of the
vocabularies in use crosses such a boundary (the codec checks this), so the best segmentation of a text is that of its
marked words. The distinct marked words of a slice of texts are sorted; walking them in order is a depth-first
traversal of their trie, and the forward scores of the prefix common with the previous word are kept. The best
segmentation has the largest sum of piece scores; of equal ones, the one whose last piece is longest. Characters without a piece are spelled as byte pieces.

The public vocabulary file has the scores of a merge-ranked vocabulary; here they are read as unigram scores, so ids are
the best segmentation by the sum of scores, not those of the library's merge encoder; decoding is the same for both.

Slices hold a bounded number of bytes, so memory does not grow with a partition; very long texts form a slice of their own.
Defined results: null gives null ids; an empty text gives none and decodes to itself. A literal mark sign is spelled
in bytes, hence every text survives encoding and decoding unchanged. Repeated rows are encoded each. Empty tables give empty results.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

MARK = "▁"
SLICE_BYTES = 3_000_000
UNKNOWN_PENALTY = 10.0
_SEGMENT = re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}")


class Codec:
    """Pieces, scores and ids of a vocabulary; plain data, so that it can be broadcast (as large as its file)."""

    def __init__(self, scores: dict[str, tuple[float, int]], byte_ids: list[int], unknown: int):
        self.scores, self.byte_ids, self.unknown = scores, byte_ids, unknown
        self.penalty = min(s for s, _ in scores.values()) - UNKNOWN_PENALTY
        self.key = uuid.uuid4().hex
        crossing = [p for p in scores if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing:
            raise ValueError(f"pieces cross word boundaries: {crossing[:5]}")
        self._endings = None
        self.pieces = {i: p.encode() for p, (_, i) in scores.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @staticmethod
    def load(path: str) -> Codec:
        """Read a SentencePiece model file with byte pieces (on the driver)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, byte_ids = {}, [-1] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                scores[sp.id_to_piece(i)] = (sp.get_score(i), i)
        if -1 in byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        return Codec(scores, byte_ids, sp.unk_id())

    @property
    def endings(self) -> tuple:
        """Trie of reversed pieces: (lookup of the character before, score or None, id). Built where it is used."""
        if self._endings is None:
            root: dict = {}
            for p, (score, i) in self.scores.items():
                node = root
                for c in p[:0:-1]:
                    node = node.setdefault(c, [{}, None, -1])[0]
                node.setdefault(p[0], [{}, None, -1])[1:] = [score, i]

            def frozen(children: dict):
                return {c: (frozen(x[0]).get, x[1], x[2]) for c, x in children.items()}

            self._endings = (frozen(root).get, None, -1)
        return self._endings

    def __getstate__(self):
        return self.__dict__ | {"_endings": None}

    def spell(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass"))

    def encode_words(self, words) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct marked word (blanks not yet marked), shared prefixes scored once.

        The best score of a prefix is the best over the pieces that end it, which a trie of reversed pieces lists.
        """
        penalty, root = self.penalty, self.endings
        out: dict[str, tuple[int, ...]] = {}
        best, back, piece, last = [0.0], [0], [0], ""
        for word in sorted(words):
            if word == "\n" or word == MARK:
                out[word] = self.spell(word)
                continue
            w = word.replace(" ", MARK)
            n = len(w)
            keep, most = 0, min(n, len(last))
            while keep < most and w[keep] == last[keep]:
                keep += 1
            del best[keep + 1 :], back[keep + 1 :], piece[keep + 1 :]
            for i in range(keep + 1, n + 1):
                top, at, own, node = best[i - 1] + penalty, i - 1, -1, root
                j = i
                while j:
                    j -= 1
                    node = node[0](w[j])
                    if node is None:
                        break
                    s = node[1]
                    if s is not None:
                        v = best[j] + s
                        if v >= top:
                            top, at, own = v, j, node[2]
                best.append(top)
                back.append(at)
                piece.append(own)
            last, i, ids = w, n, []
            while i:
                if piece[i] < 0:
                    ids.extend(reversed(self.spell(w[back[i] : i])))
                else:
                    ids.append(piece[i])
                i = back[i]
            out[word] = tuple(reversed(ids))
        return out

    def encode(self, texts: list[str | None]) -> list[array | None]:
        cut = [None if t is None else _SEGMENT.findall(" " + t) if t else [] for t in texts]
        table = self.encode_words(set(chain.from_iterable(c for c in cut if c)))
        get = table.__getitem__
        return [None if c is None else array("i", chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return self._unmark(raw, ids)

    def _unmark(self, raw: bytes, ids) -> str:
        mark = MARK.encode()
        if self.byte_ids[mark[0]] in ids:  # literal marks are spelled in bytes and stay
            spelled = {i: b for b, i in enumerate(self.byte_ids)}
            raw = b"".join(bytes([spelled[i]]) if i in spelled else self.pieces[i].replace(mark, b" ") for i in ids)
        else:
            raw = raw.replace(mark, b" ")
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t or "")
        if size > SLICE_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _encoder(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = box.value
        for b in batches:
            at = 0
            for own in _slices(b.column(1).to_pylist()):
                values, offsets, intact = array("i"), array("i", [0]), []
                for text, ids in zip(own, codec.encode(own)):
                    intact.append(None if ids is None else codec.decode(ids) == text)
                    values.extend(ids or ())
                    offsets.append(len(values))
                nulls = pa.array([x is None for x in intact], pa.bool_())
                flat = pa.array(np.frombuffer(values, np.int32) if values else np.empty(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), flat, mask=nulls)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(own)), lists, pa.array(intact, pa.bool_())], names=["doc_id", "ids", "intact"])
                at += len(own)

    return run


def decode_column(codec: Codec, spark):
    """A function from a column of id arrays to the decoded texts."""
    box = spark.sparkContext.broadcast(codec)

    @arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = box.value
        for lists in parts:
            yield pa.array([None if x is None else codec.decode(x) for x in lists.to_pylist()], pa.string())

    return decode


def encode_documents(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_ids, ids, intact per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(codec)
    out = docs.select("doc_id", "text").mapInArrow(_encoder(box), f"doc_id {kind}, ids array<int>, intact boolean")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "intact")

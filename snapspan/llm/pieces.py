"""SentencePiece encoding and decoding: best segmentation by piece scores, shared along the trie of words.

A text gets a leading space, and each space becomes a mark. A word begins at a mark that follows another character, so a run of spaces stays with the word after it; a line break starts a
word of its own if no piece holds one. All pieces of the model are used, also those of several marks. If no piece has a mark after another character, none crosses a word and the best segmentation of a
text is that of its words; with a model that has such pieces a text is one word. The distinct words of a slice of rows are
sorted, which is their trie in depth-first order: the forward scores of the prefix that a word
shares with the one before it are kept, only the rest is computed. A character that no piece covers costs the least score less ten and is
written in byte pieces. Equal scores go to the longer last piece.

The vocabulary is a SentencePiece model file; its path is a parameter, the driver reads it and its
pieces (some ten thousand, fixed by the file) are broadcast. Nothing is trained.

Null text is empty text, which has no pieces. Decoding gives back every text exactly, spaces, marks and control characters included. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A mark after another character.
INNER = re.compile("(?<=[^▁])▁")
#: Stands for a mark that is in the text itself; no text has lone surrogates.
LITERAL = "\ud800"
UNKNOWN = 10.0


@dataclass
class Vocabulary:
    """Pieces with id and score, the ids of the 256 bytes, and what each id decodes to."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int]
    decoded: list[bytes]

    def __post_init__(self):
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN
        self.breaks = not any("\n" in p for p in self.pieces)
        self.crosses = any(INNER.search(p) for p in self.pieces)
        # all endings of pieces, so that a search backwards stops where no piece can go on
        self.endings = {p[k:]: None for p in self.pieces for k in range(1, len(p))} | self.pieces

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        if self.crosses:
            return [MARK + text.replace(" ", MARK)]
        if "  " in text or text[0] == " ":
            text = INNER.sub(" " + MARK, MARK + text.replace(" ", MARK))
        else:
            text = MARK + text.replace(" ", " " + MARK)
        return (text.replace("\n", " \n") if self.breaks else text).split(" ")

    def segment(self, words) -> dict[str, tuple[tuple[int, ...], float]]:
        """Ids and score of each word, depth-first over the sorted words."""
        out, last = {}, ""
        score, back = [0.0], [(0, None)]
        find, none = self.endings.get, ()
        for word in sorted(words):
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            del score[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, step = None, (end - 1, None)
                for start in range(end - 1, -1, -1):
                    got = find(word[start:end], none)
                    if got:
                        total = score[start] + got[1]
                        if best is None or total >= best:
                            best, step = total, (start, got[0])
                    elif got is none:
                        break
                if word[end - 1] not in self.pieces and (best is None or score[end - 1] + self.unknown > best):
                    best, step = score[end - 1] + self.unknown, (end - 1, None)
                score.append(best)
                back.append(step)
            ids, at = [], len(word)
            while at:
                start, piece = back[at]
                ids += [piece] if piece is not None else [self.bytes_[b] for b in reversed(word[start:at].replace(LITERAL, MARK).encode())]
                at = start
            out[word] = tuple(reversed(ids)), score[len(word)]
            last = word
        return out

    def encode(self, texts) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each text; the words are shared among all of them."""
        cut = [self.words(t or "") for t in texts]
        found = self.segment(set().union(*cut)) if cut else {}
        raw = {w: np.array(ids, np.int32).tobytes() for w, (ids, _) in found.items()}
        cost = {w: s for w, (_, s) in found.items()}
        return [(np.frombuffer(b"".join(map(raw.__getitem__, ws)), np.int32), sum(map(cost.__getitem__, ws))) for ws in cut]

    def decode(self, ids) -> str:
        """The text again."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode("utf-8", "replace")


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file; control and unused pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_, decoded = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
            decoded.append(bytes([int(piece[1:-1], 16)]))
            continue
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        decoded.append((piece.replace(MARK, " ") if plain else "").encode())
        if plain:
            pieces[piece] = i, model.get_score(i)
    return Vocabulary(pieces, bytes_, decoded)


def _slices(texts, limit: int = 8_000_000):
    """Texts in slices of bounded length."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(spark: SparkSession, text: Column | str = "text", path: str = MODEL) -> Column:
    """Piece ids of a text column."""
    shared = spark.sparkContext.broadcast(load(path))

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([ids for part in _slices(texts) for ids, _ in shared.value.encode(part)], dtype=object)

    return F.pandas_udf(run, ArrayType(IntegerType()))(F.col(text) if isinstance(text, str) else text)


def decode(spark: SparkSession, ids: Column | str, path: str = MODEL) -> Column:
    """The texts of a column of piece ids; null stays null."""
    shared = spark.sparkContext.broadcast(load(path))

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(x) for x in column], dtype=object)

    return F.pandas_udf(run, StringType())(F.col(ids) if isinstance(ids, str) else ids)


REPORT = StructType().add("n_words", LongType()).add("n_pieces", LongType()).add("score", DoubleType()).add("ids_sha256", StringType()).add("round_trip", BooleanType())


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = MODEL) -> DataFrame:
    """Per document the number of words and pieces, the score, a digest of the ids (32-bit, little endian) and whether decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(texts: pd.Series) -> pd.DataFrame:
        v, rows = shared.value, []
        for part in _slices(texts):
            for t, (ids, score) in zip(part, v.encode(part)):
                rows.append((len(v.words(t or "")), len(ids), score, hashlib.sha256(ids.tobytes()).hexdigest(), v.decode(ids) == (t or "")))
        return pd.DataFrame(rows, columns=REPORT.fieldNames())

    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(run, REPORT)(F.col(text)).alias("r")).select("doc_id", "r.*")

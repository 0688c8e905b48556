"""Segmentation by words against Viterbi over the whole marked text and the full vocabulary."""

import random

import pytest

from snapspan.llm import pieces
from snapspan.llm.pieces import LITERAL, MARK


@pytest.fixture(scope="module")
def full():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


def whole(text, vocabulary):
    """Score and number of pieces of the best segmentation; equal scores go to the longer last piece."""
    marked = (MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else ""
    unknown, longest = min(vocabulary.values()) - pieces.UNKNOWN, max(map(len, vocabulary))
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            score = vocabulary.get(marked[start:end])
            if score is not None:
                options.append((best[start][0] + score, end - start, best[start][1] + 1))
        if marked[end - 1] not in vocabulary:
            options.append((best[end - 1][0] + unknown, 0, best[end - 1][1] + len(marked[end - 1].replace(LITERAL, MARK).encode())))
        top = max(options)
        best.append((top[0], top[2]))
    return best[-1]


def test_runs_of_spaces_and_code(full):
    v = pieces.load()
    assert not v.crosses and any(MARK * 2 == p for p in v.pieces) and set(v.pieces) == set(full)
    rng = random.Random(12)
    parts = ["a", "b", "def f(x):", "\n", "        ", "  ", " ", "return", "1", "été", "▁", "=", "\t", "zzq", "    ", "\n\n", "🙂"]
    texts = ["a    b", "x  = 1\n        y", "def f(x):\n    return x + 1\n", " ", "   ", "  lead", "tail  ", "\n", "\n  \n", "▁▁ ▁", "", " " * 40 + "x"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for text, (ids, score) in zip(texts, v.encode(texts)):
        want = whole(text, full)
        assert abs(score - want[0]) <= 1e-6 * max(1.0, abs(want[0])), (text, score, want)
        assert len(ids) == want[1], (text, len(ids), want)
        assert v.decode(ids) == text


def test_pieces_that_cross_words_keep_texts_whole():
    v = pieces.Vocabulary({"▁a": (0, -1.0), "▁b": (1, -1.0), "▁a▁b": (2, -1.5), "▁": (3, -9.0), "a": (4, -9.0), "b": (5, -9.0)}, list(range(6, 262)), [b" a", b" b", b" a b", b" ", b"a", b"b"] + [bytes([i]) for i in range(256)])
    assert v.crosses and v.words("a b") == ["▁a▁b"]
    (ids, score), = v.encode(["a b"])
    assert ids.tolist() == [2] and score == -1.5 and v.decode(ids) == "a b"

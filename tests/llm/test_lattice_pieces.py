"""The lattice's arcs against all pieces of the model file."""

import math

import numpy as np
import pyarrow as pa
import pytest

from wayside.llm import lattice_lm


def test_lattice_has_all_pieces_of_the_model():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lattice_lm.vocabulary_file())
    pieces = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    voc = lattice_lm.vocabulary(lattice_lm.vocabulary_file())
    logs = np.log(voc.start)

    def total(word: bytes) -> float:
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = ways[j - 1] * math.exp(logs[word[j - 1]])
            for i in range(j):
                if word[i:j] in pieces:
                    ways[j] += ways[i] * math.exp(logs[voc.look_up(lattice_lm._hash_of([word[i:j]]))[0]])
        return ways[-1]

    assert {" É".encode(), " На".encode()} <= pieces
    for p in pieces:
        if p.lower() == p and not set(p[1:]) & set(b" \t\n\v\f\r") and p[0] not in b"\t\n\v\f\r":
            assert voc.look_up(lattice_lm._hash_of([p]))[0] >= 0, p
    words = ["État", "На", "Москва", "the", "été"]
    for rows, lattice in lattice_lm.lattices(pa.array([w.encode().lower() for w in words], pa.binary()), voc):
        for r, a in zip(rows, lattice.forward(logs)[:, -1], strict=True):
            assert math.exp(a) == pytest.approx(total(b" " + words[r].encode().lower()))

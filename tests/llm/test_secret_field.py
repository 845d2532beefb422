"""The random field tags every token of a text: the best path over all of them, by plain Viterbi."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.llm import secret_crf as S


def over_all_tokens(text, model):
    found = list(S.TOKEN.finditer(text))
    if not found:
        return []
    ts = ["", "", *[m[0] for m in found], ""]
    of_text = S.text_features(text, sum(S.may_be_secret(m[0]) for m in found))
    none = (0.0, 0.0, 0.0)
    emission = [np.sum([model[0].get(f, none) for f in S.features(*ts[j : j + 4], of_text)], axis=0) for j in range(len(found))]
    out = []
    for m, label in zip(found, S.viterbi(np.array(emission), np.array(model[1]))):
        if label == 1:
            out.append(m.span())
        elif label == 2:
            out[-1] = (out[-1][0], m.end())
    return out


def odd_texts():
    r = random.Random(5)
    pieces = ["password", "token", "=", ":", "-", " " * 70, "\n", "x" * 60, "-" * 50, "the", "Ñandú.", "a1b2c3d4e5f6", "한국어", " ",
              "correct-horse-battery-staple", "kQzWxVbNmPlKjHgFdSaT", "+aB3dE5fG7hI9jK1lM3nO5pQ", "12", "2020-01-02", "/", "_", "my_long_password_name_for_the_key"]
    for _ in range(150):
        yield "".join(r.choice(pieces) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 25)))


def test_best_path_over_all_tokens():
    model = S.train()
    field = S.Field(model)
    lines = [" ".join(t for t, _ in line) for line in S._generated(150, 37)]
    found = 0
    for text in [*lines, "\n".join(lines), *odd_texts(), "", " \n"]:
        got = S.field_spans(text, field)
        assert got == over_all_tokens(text, model)
        found += len(got)
    assert found > 100


@pytest.mark.parametrize("seed", range(6))
def test_best_path_for_any_weights(seed):
    """Where weak tokens follow each other, and where a tagged one follows them."""
    r = np.random.default_rng(seed)
    names = S.train()[0]
    lean = np.array([seed / 4, 0, 0])
    model = {f: tuple(r.normal(size=3) + lean) for f in names}, r.normal(scale=1 + seed % 3, size=(3, 3)).tolist()
    field = S.Field(model)
    for text in odd_texts():
        assert S.field_spans(text, field) == over_all_tokens(text, model)


def test_positions_without_a_digit_and_far_neighbours():
    field = S.Field(S.train())
    phrase = "correct-horse-battery-staple"
    for text in (f"the passphrase {phrase} is", f"the passphrase{' ' * 300}{phrase} is"):
        at = text.index(phrase)
        assert (at, at + len(phrase)) in S.field_spans(text, field)


def test_small_tables_change_no_span(monkeypatch):
    texts = list(odd_texts())
    want = [S.field_spans(t, S.train()) for t in texts]
    monkeypatch.setattr(S, "WORDS", 3)
    field = S.Field(S.train())
    assert [S.field_spans(t, field) for t in texts] == want

"""Results of the training-data operators that need the whole text or the whole table."""

from __future__ import annotations

import itertools

import numpy as np
import pytest


def test_tiff_hash_covers_every_page():
    from corvane.llm import tiff

    opening = "a" * (tiff.ROW * tiff.PAGE_ROWS)
    texts = [opening + ("a" * 90 + "z" * 102) * n for n in (0, 3000)] + [opening + ("z" * 90 + "a" * 102) * 3000]
    hashes = set()
    for t in texts:
        _, data = tiff.payload(t)
        pages = [p for _, p in tiff.read_pages(tiff.store(data))]
        got = tiff.features(pages).rsplit("hash=", 1)[1]
        rows = [data[y : y + tiff.ROW] for y in range(0, len(data), tiff.ROW)]
        cuts = [tiff.ROW * k // 9 for k in range(9)] + [tiff.ROW]
        height, bands = len(rows), min(8, len(rows))
        sizes = [height // bands + (k < height % bands) for k in range(bands)]
        bits, at = "", 0
        for n in sizes:
            sums = [sum(sum(r[a:b]) for r in rows[at : at + n]) for a, b in zip(cuts, cuts[1:])]
            bits += "".join("01"[y > x] for x, y in zip(sums, sums[1:]))
            at += n
        assert int(got, 16) == int(bits, 2)
        hashes.add(got)
    assert len(hashes) == 3


def test_field_spans_that_only_touch_another_kind_stay(monkeypatch):
    from corvane.llm import pii_semicrf as P

    text = "pay AT4111111111111111 now"  # the digits pass Luhn: a base card within the account number
    (a, kind, b), = P.base_spans(text)
    assert P.KINDS[kind] == "card"
    iban, card, email = (P.TYPES.index(t) for t in ("iban", "card", "email"))
    said = [(a - 2, iban, b), (a - 2, card, b), (a, iban, b), (a + 1, email, b), (b - 1, email, b + 3)]
    monkeypatch.setattr(P, "field_spans", lambda *_: said)
    assert P.find(text, {})[1] == sorted([(a, kind, b), (a - 2, 4 + iban, b), (b - 1, 4 + email, b + 3)])


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_links_of_every_radius_among_crowds(spark, radius):
    from corvane.llm import simhash

    r = np.random.default_rng(radius)
    seen = {(0xABCDE << 40) | (k * 5) for k in range(12)}
    for base in r.integers(0, 1 << 63, 4).tolist():
        for _ in range(8):
            f = base
            for b in r.integers(0, 64, r.integers(0, 4)).tolist():
                f ^= 1 << b
            seen |= {f, f ^ 1}
    fps = sorted(seen)
    unique = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    got = {(x["a"], x["b"]) for x in simhash.links(unique, radius=radius, crowd=3, parts=3).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= radius}

"""Shapes of identifiers that confident patterns introduce."""

import pytest

from lexmill.llm import pii

SHAPES = ["ab12cd34", "12.34.5678", "DE89 3704 0044 0532 0130 00", "4711 0815", "12 345 678 901", "MX/20931/77", "u-48213", "a_7/b.99", "new@host7", "AB-993317"]


def test_identifiers_of_every_shape_are_found_whole(spark, documents):
    seeds = [(i, f"Member data. Account holder: mail{i}@example.com is known") for i in range(40)]
    shaped = [(100 + i, f"Account holder: {x}{end} is known") for i, x in enumerate(SHAPES) for end in [("", ".", ",")[i % 3]]]
    shaped += [(200, "Account holder: nobody is known"), (201, "account holder: 12 34")]
    got = {r["doc_id"]: r["spans"] for r in pii.extract(documents(seeds + shaped)).collect()}
    assert {x: got[100 + i] for i, x in enumerate(SHAPES)} == {x: f"context:16:{16 + len(x)}" for x in SHAPES}
    assert got[200] == got[201] == ""

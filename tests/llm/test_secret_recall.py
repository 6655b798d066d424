"""Random tokens in a corpus whose other long tokens are mostly slugs."""

import random

from lexmill.llm import secret_scan

WORDS = "the station report of north south and notes weather market article people history science review update special edition complete guide morning winter".split()
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_recall_is_near_one_among_slugs(spark, documents):
    rng = random.Random(11)
    planted = [(i, "see " + "".join(rng.choice(LETTERS) for _ in range(40)) + " end") for i in range(300)]
    planted += [(1000 + i, "see " + "".join(rng.choice(LETTERS + "-_") for _ in range(43)) + " end") for i in range(300)]
    slugs = [(10_000 + i, "see " + rng.choice("-_/").join([*rng.choices(WORDS, k=rng.randrange(5, 9)), str(rng.randrange(1990, 2030))]) + " end") for i in range(6000)]
    # structured tokens without a separator are in the class of the first kind
    slugs += [(20_000 + i, "see " + rng.choice(["Ab", "Xy9", "Q7w"]) * 20 + " end") for i in range(2700)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(documents(planted + slugs)).collect()}
    found = sum(got[i].startswith("random:4:") for i, _ in planted)
    assert found >= 0.99 * len(planted)
    assert sum(got[i] != "" for i, _ in slugs) <= 0.005 * len(slugs)

import collections
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_llm_operators import SCHEMA, corpus, prose  # noqa: E402

from tallyfield.llm import minhash  # noqa: E402


def expected(docs):
    return collections.Counter((d, n, c, d == c) for d, n, c in brute.components(docs, 85))


def got(frame):
    return collections.Counter(map(tuple, minhash.minhash_components(frame).collect()))


def near_copies(seed, groups, members, words, edits):
    """Groups of near copies around bases that share a passage; most pairs lie close to the threshold, on either side."""
    rng = random.Random(seed)
    passage = prose(rng, words // 4)
    docs = []
    for g in range(groups):
        base = prose(rng, words, 3000).split()
        for i in range(members):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(words)] = f"y{rng.randrange(10**6)}"
            docs.append((1000 * g + i, passage + " " + " ".join(w)))
    rng.shuffle(docs)
    return docs


def test_matches_all_pairs_with_odd_rows(spark):
    docs, rows = corpus()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(docs)
    assert minhash.minhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_no_link_is_lost_in_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_copies(block, 4, 45, 120, 9)
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == expected(docs)


def test_intersections_of_a_block():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[np.intersect1d(x, y).size if i != j else None for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    have = minhash.common_counts(sets)
    assert all(want[i][j] in (None, have[i, j]) for i in range(40) for j in range(40))


def test_agreement_bound_loses_next_to_nothing():
    import math
    count, p = minhash.BANDS * minhash.ROWS, 0.85
    lost = sum(math.comb(count, i) * p**i * (1 - p)**(count - i) for i in range(minhash.least_agreement(count, 85, 100)))
    assert lost < 1e-7 and (1 - p**minhash.ROWS)**minhash.BANDS < 1e-10

import collections
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import SCHEMA, corpus  # noqa: E402

from tallyfield.llm import spelling  # noqa: E402
from tallyfield.llm.queries import SPELLING_SQL  # noqa: E402


def plain(docs):
    """Every word against every other."""
    n = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(u, v):
        if len(u) == len(v):
            return sum(x != y for x, y in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))
    friends = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(f, key=lambda v: (-n[v], v)) for w, f in friends.items() if f}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return collections.Counter((w, c, len(friends[w]), form.get(w), n.get(form.get(w)), root(w)) for w, c in n.items())


def words(seed, letters="abé", size=260):
    rng = random.Random(seed)
    found = set()
    while len(found) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 10)))
        found |= {w, w[:3] + w[4:], w + rng.choice(letters), w[0] + w}
    return sorted(w for w in found if len(w) >= 7)


def texts(seed):
    rng = random.Random(seed)
    pool = words(seed)
    docs = [(i, " ".join(rng.choices(pool, weights=[1 / (1 + k % 37) ** 2 for k in range(len(pool))], k=400))) for i in range(12)]
    docs.append((18, "qwertyui " * 400 + "qwertyuo " * 30 + "qwertyxo " * 2))
    return docs + [(20, "ABABABAB, abababab! ÀBABABAB abababa" + "b" * 300 + " x" * 3), (21, None), (22, ""), (None, docs[0][1]), docs[1], (23, "b" * 5000 + " " + "b" * 5000), (24, "b" * 5000 + " b" + "b" * 5000)]


@pytest.mark.parametrize("hot,chunk", [(1 << 19, 1 << 19), (60, 200)])
def test_near_words_match_all_pairs(spark, monkeypatch, hot, chunk):
    """With small limits most partitions are split several times and each acceptor holds few of them."""
    monkeypatch.setattr(spelling, "HOT_LETTERS", hot)
    monkeypatch.setattr(spelling, "CHUNK_LETTERS", chunk)
    docs = texts(5) if hot > 60 else texts(5)[:17]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in spelling.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert collections.Counter(got) == plain(docs)
    assert any(r[3] and r[5] != r[3] for r in got), "no chain of forms in the test"


def test_odd_rows_and_the_sql(spark):
    docs, rows = corpus()
    docs = [(d, (t or "") + " separate seperate Separate separat") for d, t in docs] + texts(8)[:15]
    rows = [(d, t, None, None, None, "x", 1, "d", "l") for d, t in docs]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(tuple(r) for r in spelling.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == plain(docs)
    import pandas as pd
    documents = pd.DataFrame({"doc_id": pd.array([d for d, _ in docs], dtype="Int64"), "text": [t for _, t in docs]})  # noqa: F841
    sql = duckdb.sql(SPELLING_SQL).project("word, n, n_near, form, form_n, root").fetchall()
    assert collections.Counter(sql) == got
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_acceptor_numbers_its_words_and_is_minimal():
    rng = random.Random(2)
    pool = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 7))) for _ in range(60)})
    rows = spelling._labels(pool, 6)
    a = spelling.Acceptor(rows)
    for number, w in enumerate(pool):
        state, skip = a.root, 0
        for c in w:
            t = a.find(np.array([state]), np.array([ord(c)]))[0]
            state, skip = a.target[t], skip + a.skip[t]
        assert a.final[state] and skip == number
    rights = set()
    for w in pool:
        for i in range(len(w) + 1):
            rights.add(frozenset(v[i:] for v in pool if v.startswith(w[:i])))
    assert a.final.size == len(rights)

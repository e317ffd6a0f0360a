import random

from tallyfield.llm import decontam


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def test_items_without_an_id_or_under_one_id_are_found(spark):
    rng = random.Random(7)
    texts = [words(rng, 30) for _ in range(12)]
    items = [(None, t) for t in texts[:5]] + [(4, t) for t in texts[5:10]] + [(8, texts[10]), (9, texts[10])]
    docs = [(i, f"{words(rng, 20)} {t} {words(rng, 20)}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.find_leaks(docs, bench).select("doc_id", "item_id", "similarity", "start_word", "n_windows").collect()), key=str)
    assert {(d, i) for d, i, *_ in got} == {(d, None) for d in range(5)} | {(d, 4) for d in range(5, 10)} | {(10, 8), (10, 9)} and len(got) == 12
    assert all(s == 1.0 and at == 20 for _, _, s, at, _ in got)
    assert [r.doc_id for r in decontam.clean_documents(docs, bench).collect()] == [11]


def test_a_leak_removes_its_text_only(spark):
    rng = random.Random(8)
    item = words(rng, 30)
    leak = f"{words(rng, 9)} {item}"
    docs = [(None, leak), (None, words(rng, 40)), (None, None), (3, words(rng, 40)), (3, leak), (4, "")]
    clean = decontam.clean_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([d for d in docs if d[1] != leak], key=str)


def test_no_join_moves_the_words_of_a_text_with_each_position(spark, monkeypatch):
    """Joins see positions or whole texts, not a list of words for every place of a text: that grows with the square of its length."""
    frames = []
    written = decontam.kept
    monkeypatch.setattr(decontam, "kept", lambda df, name: (frames.append(df), written(df, name))[1])
    rng = random.Random(9)
    item = words(rng, 30)
    docs = spark.createDataFrame([(i, f"{words(rng, 20 * i)} {item} {words(rng, 20)}") for i in range(4)], "doc_id long, text string")
    items = decontam._items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    found = decontam.windows_near_items(docs, items, 75, 100)
    starts = {(r.length, r.start) for r in found.collect()}
    assert {(30, 20 * i) for i in range(4)} <= starts

    def joins(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        return (children if node.nodeName() == "Join" else []) + [x for c in children for x in joins(c)]
    sides = [x for f in [*frames, found] for x in joins(f._jdf.queryExecution().optimizedPlan())]
    assert sides and not [x for x in sides if '"elementType":"string"' in x.schema().json()]

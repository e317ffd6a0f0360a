import collections
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tallyfield.llm import chat, classifier, decontam, graph, jaccard, licenses, linedup, mixing, quality, sharding, suffix  # noqa: E402
from tallyfield.llm.queries import CHAT_SQL, TRICKY  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n long, digest string, label string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3):
    """Copies, near copies, repeated lines, NULLs, an empty, a blank and a very long text, a repeated row; extra columns with names used inside."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 160)) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(20 + i, base[i % 3]) for i in range(9)]
    for i in range(12):
        w = base[i % 4].split()
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        docs.append((40 + i, " ".join(w)))
    docs += [(60, None), (61, ""), (62, " \n\t "), (63, "two words"), (64, "Two WORDS"), (65, "a" * 900), (66, "line one\n" * 40), (67, prose(rng, 4000)), (None, base[5]), (None, "no id here")]
    docs += [docs[2], (68, "one\ntwo\n" + base[7] + "\n" + base[8])]
    rows = [(d, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", i, "d", "l") for i, (d, t) in enumerate(docs)]
    return docs, rows


@pytest.fixture(scope="module")
def data(spark):
    docs, rows = corpus()
    return docs, rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_jaccard_join_matches_all_pairs(spark, data, nothing):
    docs, _, frame = data
    got = bag(jaccard.jaccard_components(frame).collect())
    assert got == collections.Counter(brute.components(docs))
    assert jaccard.jaccard_components(nothing).count() == 0


def test_one_of_each_group_stays(data):
    docs, _, frame = data
    kept = jaccard.one_of_each_group(frame)
    assert kept.columns == frame.columns
    groups = collections.Counter((brute.shingle_set(t) and c, not brute.shingle_set(t)) for (_, t), (_, _, c) in zip(docs, brute.components(docs)))
    blank = len({(d, t or "") for d, t in docs if not brute.shingle_set(t)})
    assert kept.count() == sum(1 for g in groups if not g[1]) + blank


def test_traversal_of_a_large_tree_loses_no_link(spark):
    """More members than a block, near copies around several bases, all sharing a passage."""
    rng = random.Random(5)
    bases = [prose(rng, 60) for _ in range(6)]
    passage = prose(rng, 12)
    docs = []
    for i in range(700):
        w = bases[i % 6].split()
        w[rng.randrange(60)] = f"y{i}"
        docs.append((i, passage + " " + " ".join(w)))
    got = {r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {c for _, _, c in brute.components(docs)}
    assert got == want


def test_dual_traversal_prunes_but_keeps_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(80)]
    near = [np.unique(np.r_[s[:-3], rng.integers(0, 1 << 63, 3, dtype=np.uint64)]) for s in sets[:20]]
    every = sets + near
    bits = np.stack([jaccard.signature(s) for s in every])
    sizes = np.array([s.size for s in every])
    forest = jaccard._Forest(np.arange(len(every)))
    found = set(map(frozenset, jaccard.dual_traversal(bits, sizes, forest, np.arange(len(every)), [True] * len(every), set(), 0, 75, 100)))
    assert {frozenset((i, 80 + i)) for i in range(20)} <= found and len(found) < 40


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200}


def test_quality_base_rules_and_bands(data, nothing):
    docs, rows, frame = data
    got = quality.quality_verdicts(frame).collect()
    want = collections.Counter((d, *brute.base_rules(t)) for d, t in docs)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality_verdicts(nothing).count() == 0
    kept = quality.kept_documents(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in got)


def test_quality_rejects_a_text_outside_the_band(spark):
    rng = random.Random(1)
    plain = "the house stands near the river and many people walk along its bank every day while others read quietly inside".split()
    docs = [(i, " ".join(rng.choice(plain) for _ in range(90)), "en") for i in range(30)]
    docs += [(99, " ".join("".join(rng.choice("#*$%&xqzj") for _ in range(9)) for _ in range(90)), "en")]
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(99) and all(kept.values())


def test_suffix_order_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = np.r_[rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 60))), 0].astype(np.int16)
        assert suffix.suffix_order(t, 258, 10**6).tolist() == sorted(range(t.size), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("kinds", [suffix.SHARD_KINDS, 2])
def test_suffix_dedup_matches_windows(spark, data, nothing, monkeypatch, kinds):
    docs, _, frame = data
    monkeypatch.setattr(suffix, "SHARD_KINDS", kinds)
    assert bag(suffix.remove_repeats(frame).collect()) == collections.Counter(brute.suffix_rows(docs, 400))
    if kinds > 2:
        assert suffix.remove_repeats(nothing).count() == 0


def test_anchors_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 100, 60_000).astype(np.uint8)
    offsets = np.array([0, buf.size])
    whole = suffix.anchors(buf, offsets)
    monkeypatch.setattr(suffix, "PIECE", 7_000)
    parts = [np.concatenate(c) for c in zip(*suffix._text_anchors(buf, offsets, 400))]
    for a, b in zip(whole, parts):
        assert a.tolist() == b.tolist()


def test_decontamination_finds_what_all_windows_find(spark, data, nothing):
    docs, _, frame = data
    items = [(1, docs[3][1][100:300]), (2, " ".join(docs[4][1].split()[5:35])), (3, "two words"), (4, None), (5, ""), (6, prose(random.Random(77), 40)), (2, " ".join(docs[4][1].split()[5:35]))]
    w = docs[6][1].split()[2:42]
    w[20] = "changed"
    items.append((7, " ".join(w)))
    items.append((8, " ".join(docs[9][1].split() + ["more"] * 4)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame, bench).collect()}
    assert got == brute.leaks(docs, items)
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(frame, bench.limit(0)).count() == 0
    clean = decontam.clean_documents(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(d not in {x for x, _ in got} for d, _ in docs)


def test_mixing_meets_targets(spark, nothing):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(0, 60)) or None, rng.choice(["a", "b", "b", "b", None, "é"])) for i in range(900)]
    rows += [(7000, "same row here", "b")] * 90 + [(None, "no id", "a"), (None, "no id", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_words(frame).collect()
    assert bag(got) == bag(mixing.mix_words(frame.repartition(2)).collect())
    sizes = collections.Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((d, len(brute.WORD.findall(t or ""))) for d, t, _ in rows)
    taken = collections.Counter()
    for r in got:
        taken[round(r.target, 6)] += r.taken
        assert r.taken <= 2 * r.size
    for s, target in want.items():
        assert abs(taken[round(target, 6)] - target) <= 60
    copies = [r.copies for r in got if r.doc_id == 7000]
    assert len(copies) == 90 and max(copies) - min(copies) <= 1
    assert mixing.mix_words(nothing).count() == 0


def test_mixed_documents_repeat_whole_rows(data):
    _, _, frame = data
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert mixed.count() == mixing.mix_words(frame).agg(F.sum("copies")).first()[0]


def test_sharding_is_balanced_and_keeps_groups(spark, data, nothing):
    docs, _, frame = data
    got = sharding.shard_documents(frame).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, len((t or "").encode()) + 1, brute.crc(t)) for d, t in docs)
    slots, of_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in of_text.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_best_fit_takes_the_tightest_bin():
    packer = sharding.Packer(10)
    assert [packer.place(s) for s in (7, 6, 4, 3, 2)] == [0, 1, 1, 0, 2]
    rng = random.Random(3)
    sizes = sorted((rng.randrange(1, 1000) for _ in range(3000)), reverse=True)
    placed, capacity = sharding.pack(sizes, 8)
    loads = collections.Counter()
    for s, b in zip(sizes, placed):
        loads[b] += s
    assert max(loads.values()) <= capacity and max(loads.values()) - min(loads.values()) <= 20
    rooms = sharding.Capacities()
    entries = [(rng.randrange(10_000), i) for i in range(5000)]
    for e in entries:
        rooms.add(*e)
    for _ in range(2000):
        want = rng.randrange(10_000)
        best = min((e for e in entries if e[0] >= want), default=None)
        assert rooms.tightest(want) == best
        if best:
            entries.remove(best)


def turns_frame(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a \\ b <| c \\| \n end\\"), (2, 1, "assistant", None), (2, 0, None, "x<|im_end|>\n<|im_start|>"), (2, 1, "assistant", None),
            (3, 0, "odd\nrole", ""), (None, None, "user", "nobody"), (-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (4, 0, "assistant", "long " * 40_000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))


def test_chat_round_trip(spark):
    rows, frame = turns_frame(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
    assert "string_agg" in CHAT_SQL


def test_template_language():
    def show(source, messages=()):
        return "".join(p for p, _ in chat.compile_template(source)(messages))
    turns = [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]
    assert show("{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif loop.first %}?{% else %}-{% endif %}{{ m['text'] | upper }}{% endfor %}", turns) == "1?A2!B"
    assert show("{% set x = 'a' ~ 'b' %}{{ x }}{{ 'c' + 1 }}{% if not (1 == 2) and true %}y{% endif %}") == "abc1y"
    folded = chat.fold(chat.parse("x{{ 'a' ~ 'b' | upper }}{% if 1 == 1 %}y{% else %}z{% endif %}"))
    assert folded == [("text", "xaBy")]
    assert list(chat.compile_template("p{% generation %}q{% endgeneration %}")([])) == [("p", False), ("q", True)]
    for bad in ("{{ m.__class__() }}", "{% for x %}{% endfor %}", "{{ x | system }}", "{% import os %}", "{% if true %}", "{{ messages.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert show("{{ messages.items }}{{ nothing.here }}", turns) == ""
    for text in ("\\", "\\\\n", "<|", "<\\|", "\\n\n<|x|>\\", "", "é\\|"):
        assert chat.unescape(chat.escape(text)) == text == chat.unescape(chat.escape_line(text))
        assert "<|" not in chat.escape(text) and "\n" not in chat.escape_line(text)


def test_importance_sampling_ranks_held_out_documents(spark, nothing):
    rng = random.Random(8)

    def text(good):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] if good or rng.random() < 0.3 else ["spam", "click", "buy", "now"]) for _ in range(40))
    docs = [(i, text(i % 4 > 0)) for i in range(400)] + [(900, None), (901, ""), (None, "alpha beta"), (3, "alpha")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("log_weight", F.lit("x"))
    got = classifier.importance_sample(frame, labels, share=0.75).collect()
    assert len(got) == len(docs) and sum(r.kept for r in got) == -(-len(docs) * 3 // 4) and sorted(r.place for r in got) == list(range(1, len(docs) + 1))
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert np.mean([r.kept == (r.doc_id % 4 > 0) for r in held]) > 0.95
    assert all(r.log_weight == 0 for r in got if r.doc_id in (900, 901))
    assert bag(got) == bag(classifier.importance_sample(frame.repartition(1), labels, share=0.75).collect())
    assert classifier.importance_sample(nothing, labels).count() == 0
    assert all(r.kept for r in classifier.importance_sample(frame, labels.limit(0)).collect())


def test_line_templates(spark, nothing):
    rng = random.Random(4)
    docs = [(i, f"{prose(rng, 12)}\nUser agent{i} signed in from {rng.choice(['home', 'work', 'cafe' + str(i)])} today\n\n  Page {i} of 99 \nend {prose(rng, 3)}") for i in range(30)]
    docs += [(50, docs[0][1]), (51, None), (52, ""), (53, "User nobody walked along the bank"), (54, "Page x of y"), (None, docs[1][1])]
    got = {(r.doc_id, r.text): r for r in linedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit(0))).collect()}
    want = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (x.startswith("User agent") or x.startswith("  Page "))]
        want[(d, "\n".join(left))] = (len(lines), len(lines) - len(left))
    assert {k: (r.n_lines, r.n_dropped) for k, r in got.items()} == want
    assert linedup.drop_recurring_lines(nothing).count() == 0


def test_license_scan(spark, nothing):
    mit = licenses.TEMPLATES["mit"]
    wrapped = mit.replace(" and ", "\nand ")
    docs = [(1, "intro text\n" + mit + "\nmore"), (2, "first\n\n" + wrapped + "\n\nlast words of it"), (3, "Licensed under the apache license, version 2.0!"), (4, "nothing of the kind here"),
            (5, None), (6, ""), (7, "x"), (None, "Released under the MIT License."), (3, "Licensed under the apache license, version 2.0!"), (8, mit.replace("free of charge", "for nothing"))]
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit("?"))).collect()
    got = {(r.doc_id, r.unit, r.license) for r in rows}
    assert got == {(1, "line", "mit"), (2, "paragraph", "mit"), (3, "line", "apache-2.0-line"), (None, "line", "mit-line"), (8, "line", "mit"), (1, "paragraph", "mit")} | {g for g in got if g[1] == "text"}
    assert len(rows) == len(got) and all(0.75 <= r.dice <= 1 for r in rows)
    assert licenses.scan_licenses(nothing).count() == 0

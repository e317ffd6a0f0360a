"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor again.

1. Runs of letters are counted over all texts, once for each document and run inside a batch, then merged by Spark. A run whose checksum with the
   document id is divisible by 31 loses one letter (planted misspellings).
2. Two near words have an equal beginning before the edit, or an equal ending behind it, of half of the shorter word. So words are dealt by length class, side and that
   half (the initial state of the walk). Every pair meets in exactly one partition: the one of its common beginning if that is long enough, else that of its
   common ending, where words are read backwards.
3. In a task the words of many partitions make one minimised acceptor (a trie whose states with equal right languages are merged), and
   the composition is walked breadth first for all partitions at once: both tapes read the same letters, then one edit (replace or insert),
   then the same letters again up to two final states. Words are numbered by the counts on the transitions, so accepted paths are pairs of words.
4. A partition of too many letters is split by the next letter: pairs that differ later share it, pairs that differ right there share everything behind
   it, and there are no more of those than letters in the alphabet. This repeats until all partitions are small; nothing is cut off.
5. A word's form is its most frequent near word if that is ten times as frequent. Forms are followed to the last one by pointer doubling; each step
   is ten times as frequent, so rounds grow with the double logarithm of the largest count.

Defined results: NULL and empty texts have no words; a NULL doc_id deletes nothing; repeated rows count each time; ties between forms go to the smallest in code-point
order; an empty table gives an empty result; extra columns are ignored. A very long run of letters is one word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.storage import kept
from tallyfield.llm.text import mix

LETTERS = "A-Za-zÀ-ÿ"
LETTER_RUN = re.compile(f"[{LETTERS}]+")
LEAST_LENGTH, LEAST_COUNT, FACTOR, PERIOD = 7, 2, 10, 31
HOT_LETTERS = 1 << 19      # letters in one partition of words; larger ones are split
CHUNK_LETTERS = 1 << 19    # letters of whole partitions that make one acceptor
BUFFERED = 200_000         # distinct words counted inside a task before they go on
SIGMA = 256                # labels: code points up to 255
GAP = "\u0001"             # stands for the place of the edit in the name of a partition


def _runs(least_length: int, period: int):
    """(doc_id, text) -> partial counts (word, n) of words that are long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return batch
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text, doc = text.as_py(), doc.as_py()
                if not text:
                    continue
                own: Counter = Counter()
                for r in LETTER_RUN.findall(text):
                    if len(r) >= least_length:
                        own[r.encode()] += 1
                lowered: Counter = Counter()
                for raw, c in own.items():
                    lowered[raw.lower()] += c  # of bytes: only A-Z
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for raw, c in lowered.items():
                    word = raw.decode()
                    if start is not None:
                        h = zlib.crc32(raw, start)
                        if h % period == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least_length:
                                continue
                    total[word] += c
                if len(total) > BUFFERED:
                    yield emit()
        if total:
            yield emit()
    return run


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH letters that occur at least LEAST_COUNT times."""
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = base.mapInArrow(_runs(LEAST_LENGTH, PERIOD), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def dealt(words: DataFrame) -> DataFrame:
    """(class, side, key, depth, only, word, n): each word in the partitions where it can meet near words.

    The class is the length of the shorter word of a pair; depth is the number of letters before the edit that all words of the partition share (read from the
    end on side 1); only = the edit is exactly there.
    """
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("class")).where(F.col("class") >= LEAST_LENGTH)
    rows = rows.withColumn("depth", F.ceil((F.col("class") - 1) / 2).cast("int")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    walk = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    rows = rows.select("class", "side", F.substring(walk, F.lit(1), F.col("depth")).alias("key"), "depth", F.lit(False).alias("only"), "word", "n")
    done = None
    while True:
        rows = kept(rows, "spelling-dealt")
        name = ["class", "side", "key", "depth"]
        large = rows.where("not only").groupBy(name).agg(F.sum(F.length("word")).alias("letters"), F.min("word").alias("low"), F.max("word").alias("high"))
        large = large.where((F.col("letters") > HOT_LETTERS) & (F.col("low") < F.col("high")) & (F.col("depth") < F.col("class"))).select(*name, F.lit(True).alias("hot"))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(large, name, "left")
        calm = marked.where("hot is null or only").drop("hot")
        done = calm if done is None else done.unionByName(calm)
        hot = marked.where("hot and not only").drop("hot")
        hot = hot.withColumn("walk", walk)
        head = F.substring("walk", F.lit(1), F.col("depth"))
        later = hot.withColumn("key", F.substring("walk", F.lit(1), F.col("depth") + 1)).withColumn("depth", F.col("depth") + 1)
        # the edit is right here: everything behind it is shared (the shorter word of an insertion also has a gap before the letter)
        without = F.concat(head, F.lit(GAP), F.substring("walk", F.col("depth") + 2, F.length("walk")))
        gap = F.concat(head, F.lit(GAP), F.substring("walk", F.col("depth") + 1, F.length("walk")))
        here = hot.withColumn("key", F.explode(F.when(F.length("word") == F.col("class"), F.array(without, gap)).otherwise(F.array(without)))).withColumn("only", F.lit(True))
        done = done.unionByName(here.drop("walk"))
        rows = later.drop("walk")


class Acceptor:
    """Minimised acceptor of the rows of a matrix of labels (0 behind the end), given in sorted order without repeats.

    States are numbered; transitions are sorted by (state, label). ``skip`` counts the rows that come before those of a transition, so the labels of
    a path add up to a row number.
    """

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        differ = rows[1:] != rows[:-1]
        lcp = np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), width)] if n > 1 else np.array([-1])
        length = (rows > 0).sum(axis=1)
        hashes = [np.zeros(0, np.uint64)] * (width + 1)
        node_at = [np.zeros(0, np.int64)] * (width + 1)  # first row of each trie node of a depth
        for d in range(width + 1):
            node_at[d] = np.flatnonzero((lcp < d) & (length >= d)) if d else np.array([0])
        self._edges = []
        with np.errstate(over="ignore"):
            for d in range(width, -1, -1):
                at = node_at[d]
                value = np.where(length[at] == d, np.uint64(0x9E3779B97F4A7C15), np.uint64(0)).astype(np.uint64)  # a node whose own word ends here comes first among its rows
                if d < width and node_at[d + 1].size:
                    child = node_at[d + 1]
                    parent = np.searchsorted(at, child, side="right") - 1
                    add = mix(hashes[d + 1] ^ mix(rows[child, d].astype(np.uint64) + np.uint64(77)))
                    start = np.searchsorted(parent, np.arange(at.size))
                    full = np.flatnonzero(np.r_[start[1:], parent.size] > start)
                    value[full] += np.add.reduceat(add, start[full])
                    self._edges.append((d, parent, child))
                hashes[d] = mix(value)
        states, number = np.unique(np.concatenate(hashes), return_inverse=True)
        base = np.r_[0, np.cumsum([h.size for h in hashes])]
        self.final = np.zeros(states.size, dtype=bool)
        for d in range(width + 1):
            self.final[number[base[d]:base[d + 1]]] = length[node_at[d]] == d
        source, label, target, skip = [], [], [], []
        for d, parent, child in self._edges:
            source.append(number[base[d] + parent])
            label.append(rows[child, d].astype(np.int64))
            target.append(number[base[d + 1]:base[d + 2]])
            skip.append(child - node_at[d][parent])
        source, label, target, skip = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (source, label, target, skip))
        self.key, first = np.unique(source * SIGMA + label, return_index=True)
        self.label, self.target, self.skip = label[first], target[first], skip[first]
        self.start = np.searchsorted(self.key, np.arange(states.size + 1) * SIGMA)
        self.root = int(number[base[0]])

    def out(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All transitions of these states: (position among the states, transition)."""
        size = self.start[states + 1] - self.start[states]
        at = np.repeat(np.arange(states.size), size)
        return at, np.arange(at.size) - np.repeat(np.cumsum(size) - size, size) + self.start[states][at]

    def find(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Transition of each state under its label, or -1."""
        want = states * SIGMA + labels
        at = np.minimum(np.searchsorted(self.key, want), max(self.key.size - 1, 0))
        return np.where(self.key[at] == want, at, -1) if self.key.size else np.full(states.size, -1)


def compose(shorter: np.ndarray, longer: np.ndarray, short_group: np.ndarray, long_group: np.ndarray, depth: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Pairs of row numbers (a row of ``longer`` comes as its number plus the rows of ``shorter``) that one edit turns into one another.

    shorter, longer: matrices of labels, sorted within their groups, groups ascending; depth and only, one for each group: how many letters come before the edit at least, or exactly.
    """
    def coded(matrix, group):
        """Three labels in front of each word name its group, so that groups have initial states of their own."""
        names = np.stack([group >> 14 & 127, group >> 7 & 127, group & 127], axis=1) + 1
        return np.concatenate([names, matrix], axis=1)
    if not shorter.shape[0]:
        return np.zeros((0, 2), np.int64)
    a = Acceptor(coded(shorter, short_group))
    b = Acceptor(coded(longer, long_group)) if longer.shape[0] else None
    found = []

    def walk(first: Acceptor, second: Acceptor, p, q, i, j, group, barred):
        """Both tapes read the same letters to the end; barred: a label that must not come first (0: none)."""
        while p.size:
            done = first.final[p] & second.final[q]
            found.append(np.stack([i[done], j[done] + (shorter.shape[0] if second is b else 0)], axis=1))
            at, t = first.out(p)
            other = second.find(q[at], first.label[t])
            ok = (other >= 0) & (first.label[t] != barred[at])
            at, t, other = at[ok], t[ok], other[ok]
            p, q, i, j = first.target[t], second.target[other], i[at] + first.skip[t], j[at] + second.skip[other]
            barred = np.zeros(p.size, dtype=np.int64)

    def roots(acceptor, group):
        names, row = np.unique(group, return_index=True)
        state = np.full(names.size, acceptor.root)
        for shift in (14, 7, 0):
            state = acceptor.target[acceptor.find(state, (names >> shift & 127) + 1)]
        return names, state, row

    names, state, row = roots(a, short_group)
    # the same acceptor on both tapes, one letter replaced
    group, p, i, d = names, state, row, 0
    while p.size:
        at, t = a.out(p)
        edit = np.where(only[group], depth[group] == d, depth[group] <= d)[at]
        # pairs of transitions of one state: each with those behind it
        e_at, e_t = at[edit], t[edit]
        end = a.start[p[e_at] + 1]
        size = end - e_t - 1
        x = np.repeat(np.arange(e_t.size), size)
        y = np.arange(x.size) - np.repeat(np.cumsum(size) - size, size) + e_t[x] + 1
        x_t, base = e_t[x], i[e_at[x]]
        walk(a, a, a.target[x_t], a.target[y], base + a.skip[x_t], base + a.skip[y], None, np.zeros(x.size, dtype=np.int64))
        group, p, i, d = group[at], a.target[t], i[at] + a.skip[t], d + 1
    if b is not None:
        l_names, l_state, l_row = roots(b, long_group)
        both, x, y = np.intersect1d(names, l_names, return_indices=True)
        group, p, q, i, j, d = both, state[x], l_state[y], row[x], l_row[y], 0
        while p.size:
            edit = np.where(only[group], depth[group] == d, depth[group] <= d)
            e = np.flatnonzero(edit)
            at, t = b.out(q[e])
            e = e[at]
            # the longer word has one more letter here; were it also the shorter word's next one, the edit could come later
            walk(a, b, p[e], b.target[t], i[e], j[e] + b.skip[t], None, b.label[t])
            at, t = a.out(p)
            other = b.find(q[at], a.label[t])
            ok = other >= 0
            at, t, other = at[ok], t[ok], other[ok]
            group, p, q, i, j, d = group[at], a.target[t], b.target[other], i[at] + a.skip[t], j[at] + b.skip[other], d + 1
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _labels(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, 0 behind their end."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), dtype=np.uint8)
    return flat.reshape(len(words), width).astype(np.int64)


def near_rows(rows: list[tuple]) -> dict[str, tuple]:
    """Whole partitions (class, side, key, depth, only, word, n) of one class -> {word: (near words, count of the best, the best)}."""
    size = rows[0][0]
    rows = sorted(set(rows), key=lambda r: (r[1], r[2], r[3], r[4], r[5][::-1] if r[1] else r[5]))
    group, names = [], {}
    for r in rows:
        group.append(names.setdefault(r[1:5], len(names)))
    group = np.array(group)
    depth = np.array([g[2] for g in names])
    only = np.array([g[3] for g in names])
    side = np.array([g[0] for g in names])
    words = [r[5][::-1] if r[1] else r[5] for r in rows]
    short = np.array([len(w) == size for w in words])
    s, l = np.flatnonzero(short), np.flatnonzero(~short)
    order = np.concatenate([s, l])
    pairs = compose(_labels([words[i] for i in s], size), _labels([words[i] for i in l], size + 1), group[s], group[l], depth, only)
    pairs = order[pairs]
    found: dict[str, tuple] = {}
    for x, y in pairs.tolist():
        u, v = rows[x], rows[y]
        if side[group[x]]:
            begin, at = min(len(u[5]), len(v[5])), 0
            while at < begin and u[5][at] == v[5][at]:
                at += 1
            if at >= -(-(size - 1) // 2):
                continue  # found by its common beginning
        for me, other in ((u, v), (v, u)):
            count, n, best = found.get(me[5], (0, 0, ""))
            if other[6] > n or other[6] == n and other[5] < best:
                n, best = other[6], other[5]
            found[me[5]] = (count + 1, n, best)
    return found


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition -> (word, n_near, best_n, best), a row for each word and acceptor."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = near_rows(rows)
        count, n, best = zip(*found.values()) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())],
                                          names=["word", "n_near", "best_n", "best"])
    ready, open_, letters, name, groups = [], [], 0, None, 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:5] != name:
                if len(open_) > 1:  # a word alone has no near words here
                    ready += open_
                    letters += sum(len(r[5]) for r in open_)
                    groups += 1
                if ready and (letters > CHUNK_LETTERS or groups >= 1 << 20 or row[0] != ready[0][0]):
                    yield solve(ready)
                    ready, letters, groups = [], 0, 0
                open_, name = [], row[:5]
            open_.append(row)
    if len(open_) > 1:
        if ready and ready[0][0] != open_[0][0]:
            yield solve(ready)
            ready = []
        ready += open_
    if ready:
        yield solve(ready)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary."""
    words = kept(vocabulary(docs), "spelling-words")
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = ["class", "side", "key", "depth", "only"]
    parts = dealt(words).select(*name, "word", "n").repartition(shuffle, *name).sortWithinPartitions(*name)
    near = parts.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    strong = -F.col("best.n") >= FACTOR * F.col("n")
    full = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                   F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"))
    full = kept(full, "spelling-forms")
    hops = full.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = hops.toDF("root", "further")
        hops = kept(hops.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-hops")
        if hops.where("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return full.join(hops.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

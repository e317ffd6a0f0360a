"""Suffix-array deduplication: every byte covered by a string of 400 bytes that also starts somewhere else is removed.

1. Equal texts are one class; a text with a copy and at least 400 bytes goes completely.
2. Each window of 400 bytes has an anchor: the leftmost 32-byte gram whose hash is least in it. Equal windows have equal anchors, so only windows of anchors that
   occur twice can be repeats, and everything else is never looked at again. The bytes of an anchor's windows are its snippet. Equal
   snippets of different anchors are repeats as a whole.
3. Snippets that share an anchor but differ are sorted: one of each kind goes to the shard of its anchor. Each shard builds a suffix array by induced
   sorting: suffixes are classified, leftmost-smaller substrings sorted and named, the reduced string ranked, all others induced bucket by bucket, which
   is linear and vectorised. Permuted common prefixes of neighbours that reach the length mark the repeated windows.
4. An anchor with more kinds of snippets than fit in a shard (a passage in a large part of all documents) has its windows counted by
   128-bit fingerprints instead, in blocks that are cut smaller only where needed; counts are combined before the shuffle.
5. Covered ranges of a text are joined and cut out.

Matches never cross documents; copies within one document count, also overlapping ones.

Defined results: NULL and empty texts have 0 bytes and keep nothing to remove; texts under 400 bytes never change; repeated rows are copies of one
another; NULL ids come back; an empty table gives an empty result; extra columns are ignored. A very long text is worked on in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.storage import kept
from tallyfield.llm.text import BYTE_CODES, chunks, mix, powers

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 19
SHARD_KINDS = 1024      # kinds of snippets of one anchor that a shard takes
PIECE = 1 << 22         # longer texts are searched in pieces of this size
EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- anchors

def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values: running extremes of blocks, forwards and backwards."""
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = values.size - width + 1
    blocks = np.full((-(-values.size // width), width), fill, dtype=np.uint64)
    blocks.ravel()[:values.size] = values
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def _running(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash of a buffer and the inverse powers that shift them."""
    up, down = powers(buf.size)
    sums = np.zeros(buf.size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[buf] * up[:buf.size], out=sums[1:])
    return sums, down


def _hash_between(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(((sums[b] - sums[a]) * down[a]) ^ ((b - a).astype(np.uint64) * np.uint64(0xDB4F0B9175AE2165)))


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, position in the row, hash of the anchor's gram, hash of its snippet, first and last window it owns) of all anchors.

    A window belongs to the leftmost of its least grams, which depends on the window's bytes alone. The snippet spans the windows owned.
    """
    none = (*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 2)
    width = length - GRAM + 1
    if buf.size < length:
        return none
    sums, down = _running(buf)
    grams = buf.size - GRAM + 1
    at = np.arange(grams)
    h = np.maximum(_hash_between(sums, down, at, at + GRAM), np.uint64(1))
    least = _sliding(h, width, True)
    whole = np.zeros(least.size, dtype=bool)  # windows within one row
    sizes = np.diff(offsets)
    long_rows = np.flatnonzero(sizes >= length)
    for r in long_rows.tolist():
        whole[offsets[r]:offsets[r + 1] - length + 1] = True
    least[~whole] = 0
    padded = np.zeros(least.size + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1:width - 1 + least.size] = least
    pos = np.flatnonzero(_sliding(padded, width, False)[:grams] == h)
    # windows come in runs with one least hash; an anchor owns those of its run that start after the previous equal gram and no later than itself
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    stop = np.r_[cut[1:], least.size] - 1
    real = whole[cut]
    cut, stop = cut[real], stop[real]
    values, of_anchor = np.unique(h[pos], return_inverse=True)
    span = buf.size + 1
    keys = of_anchor * span + pos
    order = np.argsort(keys, kind="stable")
    before = np.full(pos.size, -1, dtype=np.int64)
    same = of_anchor[order][1:] == of_anchor[order][:-1]
    before[order[1:][same]] = pos[order[:-1][same]]
    run_keys = np.searchsorted(values, least[cut]) * span + cut
    run_order = np.argsort(run_keys, kind="stable")
    found = np.searchsorted(run_keys[run_order], keys, side="right") - 1
    run = run_order[np.maximum(found, 0)]
    ok = (found >= 0) & (least[cut[run]] == h[pos]) if cut.size else np.zeros(pos.size, dtype=bool)
    first = np.maximum(cut[run], before + 1) if cut.size else pos
    last = np.minimum(stop[run], pos) if cut.size else pos
    ok &= (first <= last) & (first >= pos - (length - GRAM))
    pos, first, last = pos[ok], first[ok], last[ok]
    row = np.searchsorted(offsets, pos, side="right") - 1
    snippet = mix(_hash_between(sums, down, first, last + length) ^ mix((pos - first).astype(np.uint64)))
    base = offsets[row]
    return row, pos - base, h[pos], snippet, first - base, last - base


def _text_anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a chunk; a text beyond PIECE bytes in pieces that overlap enough to give what the whole text gives."""
    if buf.size <= 2 * PIECE:
        yield anchors(buf, offsets, length)
        return
    margin = 4 * length
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for start in range(a, b, PIECE):
            low, high = max(a, start - margin), min(b, start + PIECE + margin)
            _, pos, h, s, first, last = anchors(buf[low:high], np.array([0, high - low]), length)
            own = (pos + low >= start) & (pos + low < start + PIECE)
            yield np.full(int(own.sum()), r), pos[own] + low - a, h[own], s[own], first[own] + low - a, last[own] + low - a


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(0)
            for first, buf, offsets in chunks(batch.column(1)):
                for row, pos, h, s, a, b in _text_anchors(buf, offsets, length):
                    yield pa.RecordBatch.from_arrays([digests.take(pa.array(row + first)), *[pa.array(c, pa.int64()) for c in (pos, a, b)],
                                                      pa.array(h.view(np.int64)), pa.array(s.view(np.int64))], names=["digest", "pos", "a", "b", "hash", "kind"])
    return run


# ---------------------------------------------------------------- induced sorting

def _classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their successor, and the leftmost of each run of those. The last symbol is the smallest."""
    n = t.size
    up = np.zeros(n, dtype=bool)
    up[-1] = True
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        nxt = np.searchsorted(differs, np.arange(n - 1))
        up[:-1] = np.where(nxt < differs.size, t[differs[np.minimum(nxt, max(differs.size - 1, 0))]] < t[differs[np.minimum(nxt, max(differs.size - 1, 0))] + 1], False)
    left = np.zeros(n, dtype=bool)
    left[1:] = up[1:] & ~up[:-1]
    return up, np.flatnonzero(left)


def _split(suffixes: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Suffixes by first symbol, order kept."""
    if not suffixes.size:
        return
    symbol = t[suffixes]
    order = np.argsort(symbol, kind="stable")
    symbol, suffixes = symbol[order], suffixes[order]
    cuts = np.r_[0, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, symbol.size]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(symbol[a]), suffixes[a:b]


def _induce(t: np.ndarray, up: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in order. Buckets are filled whole; runs of one symbol go round by round."""
    seed_of: list[np.ndarray | None] = [None] * sigma
    for c, part in _split(seeds, t):
        seed_of[c] = part
    falling: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma):
        newest = np.concatenate(falling[c]) if falling[c] else seeds[:0]
        falling[c] = [newest]
        while newest.size:  # larger suffixes that start with the same symbol
            before = newest[newest > 0] - 1
            newest = before[(t[before] == c) & ~up[before]]
            if newest.size:
                falling[c].append(newest)
        scan = np.concatenate([*falling[c], *([seed_of[c]] if seed_of[c] is not None else [])])
        falling[c] = [np.concatenate(falling[c])]
        before = scan[scan > 0] - 1
        for d, part in _split(before[~up[before] & (t[before] > c)], t):
            falling[d].append(part)
    rising: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    rising[int(t[-1])].append(np.array([t.size - 1]))
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):
        newest = np.concatenate(rising[c]) if rising[c] else seeds[:0]
        rounds = [newest]
        while newest.size:
            before = newest[newest > 0] - 1
            newest = before[(t[before] == c) & up[before]]
            if newest.size:
                rounds.append(newest)
        descending = np.concatenate(rounds)
        scan = np.concatenate([descending, falling[c][0][::-1]])
        out.append(scan)
        before = scan[scan > 0] - 1
        for d, part in _split(before[up[before] & (t[before] < c)], t):
            rising[d].append(part)
    return np.concatenate(out)[::-1]


def suffix_order(t: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Suffixes of t (its last symbol is unique and the smallest) in order of at least their first ``depth`` symbols."""
    up, left = _classify(t)
    if left.size < 2:
        return _induce(t, up, left, sigma)
    # sort the leftmost-smaller substrings by inducing from any order of their starts, then name them
    rough = _induce(t, up, left, sigma)
    is_left = np.zeros(t.size, dtype=bool)
    is_left[left] = True
    ordered = rough[is_left[rough]]
    number = np.full(t.size, -1, dtype=np.int64)
    number[left] = np.arange(left.size)
    ends = np.r_[left[1:] + 1, t.size]
    with np.errstate(over="ignore"):
        up_powers, down = powers(t.size)
        sums = np.zeros(t.size + 1, dtype=np.uint64)
        np.cumsum(mix(t.astype(np.uint64) + np.uint64(1)) * up_powers[:t.size], out=sums[1:])
    content = _hash_between(sums, down, left, ends)[number[ordered]]
    name = np.zeros(left.size, dtype=np.int64)
    name[number[ordered]] = np.cumsum(np.r_[0, content[1:] != content[:-1]])
    # rank the reduced string; a substring advances two symbols at least, so 'depth' is reached after depth / 2 names
    step = 1
    while name.max() < left.size - 1 and step * 2 < depth + 2:
        following = np.zeros(left.size, dtype=np.int64)
        following[:-step] = name[step:] + 1
        key = name * (left.size + 1) + following
        order = np.argsort(key, kind="stable")
        name[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        step *= 2
    return _induce(t, up, left[np.argsort(name, kind="stable")], sigma)


def repeated_windows(pieces: list[bytes], where: np.ndarray, several: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the starts of its windows that occur at another place too.

    where: place of each piece's first byte in the whole input (a window at the same place in two pieces is one occurrence). several: pieces that stand for
    more than one place.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(np.r_[0, sizes + 1])
    t = np.zeros(starts[-1] + 1, dtype=np.int16)
    for p, a in zip(pieces, starts.tolist()):
        t[a:a + len(p)] = np.frombuffer(p, dtype=np.uint8)
        t[a:a + len(p)] += 2
        t[a + len(p)] = 1
    order = suffix_order(t, 258, length)
    piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)
    piece_of = np.r_[piece_of, -1]
    local = np.arange(t.size) - starts[piece_of]
    valid = (piece_of >= 0) & (local + length <= sizes[piece_of])
    order = order[valid[order]]
    if not order.size:
        return [np.zeros(0, np.int64) for _ in pieces]
    # permuted common prefix of a suffix and its predecessor reaches the length: compared as one hash of that many symbols
    raw = (np.maximum(t, 2) - 2).astype(np.uint8)
    sums, down = _running(raw)
    code = _hash_between(sums, down, order, order + length)
    run = np.cumsum(np.r_[0, code[1:] != code[:-1]])
    cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
    place = where[piece_of[order]] + local[order]
    again = (np.minimum.reduceat(place, cuts) != np.maximum.reduceat(place, cuts)) | np.logical_or.reduceat(several[piece_of[order]], cuts)
    again &= (np.diff(np.r_[cuts, order.size]) > 1) | np.logical_or.reduceat(several[piece_of[order]], cuts)
    hit = order[again[run]]
    hit = hit[np.argsort(hit, kind="stable")]
    bounds = np.searchsorted(piece_of[hit], np.arange(len(pieces) + 1))
    return [local[hit[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows at sorted starts."""
    if not starts.size:
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, starts.size - 1]] + length).tolist()))


def _cuts(length: int):
    """Texts with the places of snippets wanted from them -> the snippets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for digest, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    snippet = raw[w["a"]:w["b"] + length]
                    out.append((digest.as_py(), w["a"], w["pos"], w["hash"], w["several"], snippet))
                    size += len(snippet)
                    if size > (1 << 22):
                        yield _snippets(out)
                        out, size = [], 0
            if out:
                yield _snippets(out)
    return run


SNIPPETS = "digest binary, start long, pos long, hash long, several boolean, snippet binary"


def _snippets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SNIPPETS.split(", ")])


def _found(rows: list[tuple]) -> pa.RecordBatch:
    digest, a, b = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["digest", "a", "b"])


def _sorted_shards(length: int):
    """Snippets sorted by shard -> repeated byte ranges of the texts they come from."""
    def of_shard(rows: list[tuple]) -> list[tuple]:
        digests = sorted({r[1] for r in rows})
        number = {d: i for i, d in enumerate(digests)}
        where = np.array([(number[r[1]] << 40) + r[2] for r in rows])
        several = np.array([r[3] for r in rows])
        marked = repeated_windows([r[4] for r in rows], where, several, length)
        return [(r[1], a + r[2], b + r[2]) for r, m in zip(rows, marked) if not r[3] for a, b in _ranges(m, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and row[0] != held[0][0]:
                    found.extend(of_shard(held))
                    held = []
                held.append(row)
            if found:
                yield _found(found)
        if held:
            yield _found(of_shard(held))
    return run


def _block_codes(length: int, step: int):
    """Snippets with ranges [s, e) of window starts -> blocks of at most ``step`` windows, aligned at the anchor.

    ``core`` is what all windows of the whole block have in common, ``union`` what the windows present cover.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, (start, pos, ranges) in enumerate(zip(batch.column("start").to_pylist(), batch.column("pos").to_pylist(), batch.column("ranges").to_pylist())):
                raw = np.frombuffer(batch.column("snippet")[i].as_buffer(), dtype=np.uint8)
                s, e = [], []
                for r in ranges:
                    edges = np.arange(pos + (r["s"] - pos) // step * step, r["e"] + step, step)
                    low, high = np.maximum(edges[:-1], r["s"]), np.minimum(edges[1:], r["e"])
                    s.append(low[low < high])
                    e.append(high[low < high])
                if not s:
                    continue
                s, e = np.concatenate(s) - start, np.concatenate(e) - start
                block = (s + start - pos) // step * step + pos - start
                inner, outer = (block + step - 1, block + length), (s, e - 1 + length)
                for j, (bits, salt) in enumerate(((raw, 0), (raw ^ 0x5A, 0x6A09E667F3BCC909))):
                    sums, down = _running(bits)
                    for k, (x, y) in enumerate((inner, outer)):
                        out[2 * k + j].append(mix(_hash_between(sums, down, x, y) ^ np.uint64(salt)).view(np.int64))
                out[4].append(s + start)
                out[5].append(e + start)
                out[6].append(np.full(s.size, i))
            if not out[4]:
                continue
            cols = [np.concatenate(c) for c in out[:7]]
            rows = pa.array(cols[6])
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols[:6]], *[batch.column(c).take(rows) for c in ("digest", "start", "several")]],
                                             names=["cx", "cy", "ux", "uy", "s", "e", "digest", "start", "several"])
    return run


def _by_counting(snippets: DataFrame, length: int) -> DataFrame:
    """Repeated byte ranges (digest, a, b) of snippets of anchors with very many kinds, by counts of 128-bit fingerprints.

    A block whose union is repeated is repeated as a whole, a block whose core is not cannot hold a repeat, others are cut into
    smaller blocks, down to single windows.
    """
    ranges = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.octet_length("snippet") - length + 1).cast("long").alias("e")))
    left = snippets.withColumn("ranges", ranges)
    out = None
    for step in (48, 6, 1):
        blocks = left.select("digest", "start", "pos", "several", "snippet", "ranges").mapInArrow(
            _block_codes(length, step), "cx long, cy long, ux long, uy long, s long, e long, digest binary, start long, several boolean")
        blocks = kept(blocks.withColumn("place", F.xxhash64("digest", "s")), "suffix-blocks")
        seen = blocks.groupBy("ux", "uy").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("several").alias("any"))
        unions = kept(seen.where("lo <> hi or any").select("ux", "uy", "lo"), "suffix-unions")
        hit = blocks.where("not several").join(unions, ["ux", "uy"], "left_semi").select("digest", F.col("s").alias("a"), (F.col("e") - 1 + length).alias("b"))
        out = hit if out is None else out.union(hit)
        if step > 1:
            # one block stands for each repeated union, so that blocks of another shape still find it
            open_blocks = blocks.join(unions, ["ux", "uy"], "left").where("lo is null or lo = place")
            open_blocks = kept(open_blocks.withColumn("several", F.col("several") | F.col("lo").isNotNull()), "suffix-open")
            cores = open_blocks.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("several").alias("settled")).where("n > 1 and not settled")
            again = open_blocks.join(cores, ["cx", "cy"], "left_semi").groupBy("digest", "start", "several").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
            left = snippets.drop("several").join(kept(again, "suffix-again"), ["digest", "start"])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with repeated ranges -> bytes removed, runs removed, digest of what is left."""
    for batch in batches:
        removed, spans, left = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            total, runs, upto, rest = 0, 0, 0, hashlib.sha256()
            last = -1
            for a, b in sorted((r["a"], r["b"]) for r in ranges.as_py()):
                if a > last:
                    runs += 1
                    rest.update(raw[max(upto, 0):a])
                    total += b - a
                    last = b
                elif b > last:
                    total += b - last
                    last = b
                upto = last
            rest.update(raw[max(upto, 0):])
            removed.append(total)
            spans.append(runs)
            left.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.string())],
                                         names=["digest", "removed", "spans", "left"])


def removed_ranges(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """For texts(digest, text): repeated byte ranges (digest, a, b) outside whole copies, and the texts (digest, text) concerned, once each."""
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(_anchor_rows(length), "digest binary, pos long, a long, b long, hash long, kind long")
    # copies of a text have the same anchors: they count once
    found = kept(found.groupBy("hash", "kind", "digest", "pos", "a", "b").agg(F.count(F.lit(1)).alias("n")).drop("n"), "suffix-anchors")
    kinds = kept(found.groupBy("hash", "kind").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("digest", "pos", "a", "b")).alias("one")), "suffix-kinds")
    groups = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("n_kinds"), F.sum("places").alias("n_places")).where("n_places > 1")
    groups = kept(groups, "suffix-groups")
    repeated = kinds.where("places > 1").select("hash", "kind")
    whole = kept(found.join(repeated, ["hash", "kind"], "left_semi").select("digest", "a", (F.col("b") + length).alias("b")), "suffix-whole")
    sent = (kinds.join(groups.where("n_kinds > 1").select("hash"), "hash", "left_semi")
            .select("one.digest", F.struct("one.pos", "one.a", "one.b", "hash", (F.col("places") > 1).alias("several")).alias("w")))
    wanted = kept(sent.groupBy("digest").agg(F.collect_list("w").alias("wanted")), "suffix-wanted")
    concerned = whole.select("digest").union(wanted.select("digest")).distinct()
    once = kept(texts.join(concerned, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")), "suffix-texts")
    cut = once.join(wanted, "digest").select("digest", "text", "wanted")
    snippets = kept(cut.mapInArrow(_cuts(length), SNIPPETS).join(groups.select("hash", "n_kinds"), "hash"), "suffix-snippets")
    total = snippets.agg(F.coalesce(F.sum(F.octet_length("snippet")), F.lit(0)).alias("b")).first().b
    shards = max(1, -(-total // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("hash"), F.lit(shards)).alias("shard")
    ordered = (snippets.where(F.col("n_kinds") <= SHARD_KINDS).select(shard, "digest", "start", "several", "snippet")
               .repartition(width, "shard").sortWithinPartitions("shard", "digest", "start"))
    by_sorting = ordered.mapInArrow(_sorted_shards(length), "digest binary, a long, b long")
    by_counting = _by_counting(snippets.where(F.col("n_kinds") > SHARD_KINDS), length)
    return by_sorting.union(by_counting).union(whole), once


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = kept(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own")), "suffix-rows")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", F.lit(True).alias("copied"))
    ranges, once = removed_ranges(texts.where(F.octet_length("text") >= length).select("digest", "text"), length)
    gathered = ranges.distinct().groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    cut = once.join(gathered, "digest").select("digest", "text", "ranges").mapInArrow(_remove, "digest binary, removed long, spans long, left string")
    known = kept(cut.join(copies, "digest", "full"), "suffix-results")
    joined = rows.join(known, "digest", "left")
    all_of_it = F.coalesce(F.col("copied"), F.lit(False))
    return joined.select(
        "doc_id", "n_bytes",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_of_it, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_of_it, F.lit(EMPTY)).otherwise(F.coalesce("left", "own")).alias("kept_sha256"))

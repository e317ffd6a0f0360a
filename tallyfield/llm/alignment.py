"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes, over a whole corpus.

An Arrow-native pipeline. Texts are encoded in pieces of bounded bytes; from there on a piece is a few flat arrays:

1. Token lists are flattened with parent indices (the document of each token). Taking the token bytes by id gives the bytes each vocabulary stands for, which
   are compared with the text; a document that either vocabulary does not restore has no tokens.
2. Segmented cumulative sums of byte lengths give the end of each token; a document's ends lie behind those of the documents before it, so one number is
   the (document, end) key.
3. An Acero hash join on these keys finds the places where tokens of both end; they cut the tokens into groups. Between two consecutive ends of
   either kind lies exactly one linked pair of tokens, so links are as many as ends.
4. Documents of a piece are joined to blocks of bounded bytes. Each block counts, by Table.group_by, how many of its documents hold each id pair. Spark merges these
   partial counts, finds the largest of each A id, and sends each block the counts of its own pairs back; the documents travel as a compressed
   row for each piece, in numbers of the block's pair list (most frequent first).

Defined results: NULL and empty texts, and texts that do not come back byte by byte, have zeros and an empty digest; NULL ids come back; repeated rows are
documents of their own and count in the corpus; an empty table gives an empty result; extra columns are ignored. A very long text is a piece of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.storage import kept

FOLDER = "/opt/tokenizers"
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 1 << 24
# fixed value: the published pre-tokenizer pattern of the byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODEC = "zstd"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """Letters of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies with the bytes of each token. Loaded once in each Python worker."""

    _loaded: dict[int, "Tokenizers"] = {}

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken

        vocab = json.loads(byte_json)["model"]["vocab"]
        letters = _byte_letters()
        special = {t["content"] for t in json.loads(byte_json)["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        # ids of this vocabulary are the order of its merges, so they are the ranks of the encoder
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.sizes = tuple(pc.binary_length(x).to_numpy().astype(np.int64) for x in self.bytes)
        self.names = tuple(pa.array([str(i) for i in range(len(x))]) for x in self.bytes)
        self.pair_base = len(b_bytes)

    @classmethod
    def of(cls, byte_json: bytes, piece_model: bytes) -> "Tokenizers":
        key = hash((byte_json, piece_model))
        if key not in cls._loaded:
            cls._loaded[key] = cls(byte_json, piece_model)
        return cls._loaded[key]

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        offsets = np.cumsum([0, *map(len, a)])
        flat = np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
        b = self.b.encode(texts, num_threads=1)
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(b, pa.large_list(pa.int64()))


def _flat(lists: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and the list each is in."""
    return pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()


def _data(column: pa.Array) -> np.ndarray:
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[:pc.sum(pc.binary_length(column)).as_py() or 0] if data is not None else np.zeros(0, np.uint8)


def _restored(ids: np.ndarray, parents: np.ndarray, tokens: pa.Array, sizes: np.ndarray, want: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each document's tokens are its own bytes."""
    n = ends.size
    length = np.diff(ends, prepend=0)
    got = np.bincount(parents, weights=sizes[ids], minlength=n).astype(np.int64)
    ok = got == length
    if ok.all():
        bad = np.flatnonzero(_data(tokens.take(pa.array(ids))) != want)
        ok[np.searchsorted(ends, bad, side="right")] = False
        return ok
    have = _data(tokens.take(pa.array(ids[ok[parents]])))
    inside = np.repeat(ok, length)
    rest = np.cumsum(np.where(ok, length, 0))
    bad = np.flatnonzero(have != want[inside])
    ok[np.flatnonzero(ok)[np.searchsorted(rest[ok], bad, side="right")]] = False
    return ok


def align(vocabularies: Tokenizers, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Counts and digests of each text, and its linked id pairs with their numbers: pair = A id * pair_base + B id."""
    n = len(texts)
    raw = [b" " + t.encode() for t in texts]
    length = np.array([len(r) for r in raw], dtype=np.int64)
    lists = vocabularies.encode(texts)
    flat = [_flat(x) for x in lists]
    want, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(length)
    ok = length > 1
    for (ids, parents), tokens, sizes in zip(flat, vocabularies.bytes, vocabularies.sizes):
        ok &= _restored(ids, parents, tokens, sizes, want, ends)
    flat = [(ids[ok[parents]], parents[ok[parents]]) for ids, parents in flat]
    (a, a_doc), (b, b_doc) = flat
    # lengths of restored documents add up the same way for both vocabularies: (document, end) as one number
    a_end, b_end = (np.cumsum(sizes[ids]) for ids, sizes in zip((a, b), vocabularies.sizes))
    left = pa.table({"end": a_end, "i": np.arange(a.size)})
    right = pa.table({"end": b_end, "j": np.arange(b.size)})
    cuts = left.join(right, "end", join_type="inner", use_threads=False).sort_by("end")
    cut_a, cut_b = cuts["i"].to_numpy(), cuts["j"].to_numpy()  # last tokens of the groups

    every = np.union1d(a_end, b_end)
    i, j = np.searchsorted(a_end, every), np.searchsorted(b_end, every)
    doc = a_doc[i]
    pair = a[i] * vocabularies.pair_base + b[j]
    span = len(vocabularies.sizes[0]) * vocabularies.pair_base
    keys, number = np.unique(doc * span + pair, return_counts=True)

    # a1,a2|b1;a3|b2,b3
    sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, cut + 1], pa.int32()), names.take(pa.array(ids))), ",")
             for cut, ids, names in ((cut_a, a, vocabularies.names[0]), (cut_b, b, vocabularies.names[1]))]
    groups = pc.binary_join_element_wise(*sides, "|")
    group_doc = a_doc[cut_a]
    n_groups = np.bincount(group_doc, minlength=n)
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_groups)], pa.int32()), groups), ";")
    digest = [hashlib.sha256(s.as_buffer()).hexdigest() if good else "" for s, good in zip(said, ok.tolist())]
    return {"n_a": np.bincount(a_doc, minlength=n), "n_b": np.bincount(b_doc, minlength=n), "n_groups": n_groups, "n_links": np.bincount(doc, minlength=n),
            "digest": digest, "doc": keys // span, "pair": keys % span, "number": number}


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of each place, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec(_CODEC).compress(planes.tobytes(), asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec(_CODEC).decompress(blob, 4 * n), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


PARTS = ("block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, kinds array<int>, ranks binary, "
         "numbers binary, pairs array<long>, holders array<long>")


def _encode(files):
    """(doc_id, text) -> rows of a block: one for each piece of documents, and one with the block's pairs and the documents that hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Tokenizers.of(*files.value)
        task = TaskContext.get().partitionId() << 32
        count, pieces, size = 0, [], 0
        schema = pa.schema([("block", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("ids", "n_a", "n_b", "n_groups", "n_links")], ("digests", pa.list_(pa.string())),
                            ("kinds", pa.list_(pa.int32())), ("ranks", pa.binary()), ("numbers", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])

        def block() -> Iterator[pa.RecordBatch]:
            every = pa.table({"pair": np.concatenate([p["pair"] for _, p in pieces])})
            counts = every.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by([("count_all", "descending"), ("pair", "ascending")])
            pairs, holders = counts["pair"].to_numpy(), counts["count_all"].to_numpy()
            order = np.argsort(pairs)
            for ids, p in pieces:
                rank = order[np.searchsorted(pairs, p["pair"], sorter=order)]
                # ranks ascend within a document, so their steps are small
                by = np.lexsort((rank, p["doc"]))
                rank, doc, number = rank[by], p["doc"][by], p["number"][by]
                fresh = np.r_[True, doc[1:] != doc[:-1]] if doc.size else np.zeros(0, bool)
                step = np.where(fresh, rank, rank - np.r_[0, rank[:-1]]) if doc.size else rank
                kinds = np.bincount(doc, minlength=len(ids))
                yield row(ids, p, kinds, _packed(step), _packed(number), None, None)
            yield row(None, None, None, None, None, pairs, holders)

        def row(ids, p, kinds, ranks, numbers, pairs, holders) -> pa.RecordBatch:
            values = [task + count, ids, *([None] * 5 if p is None else [p["n_a"], p["n_b"], p["n_groups"], p["n_links"], p["digest"]]), kinds, ranks, numbers, pairs, holders]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        def taken(ids: list, texts: list[str]) -> None:
            pieces.append((ids, align(vocabularies, texts)))

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if held and held + len(text) > PIECE_BYTES:
                    taken(ids, texts)
                    size, ids, texts, held = size + held, [], [], 0
                    if size >= BLOCK_BYTES:
                        yield from block()
                        count, pieces, size = count + 1, [], 0
                ids.append(i)
                texts.append(text)
                held += len(text) + 64
        if ids:
            taken(ids, texts)
        if pieces:
            yield from block()
    return run


def _summed(_key, parts: pa.Table, counts: pa.Table) -> pa.Table:
    """Pieces of a block and the corpus-wide counts of its pairs -> results of the documents."""
    size = counts.num_rows
    total, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    at = counts["rank"].to_numpy()
    total[at] = counts["total"].to_numpy()
    best[at] = counts["best"].to_numpy(zero_copy_only=False)
    out = []
    for p in parts.to_pylist():
        kinds = np.array(p["kinds"], dtype=np.int64)
        n = int(kinds.sum())
        step, number = _unpacked(p["ranks"], n), _unpacked(p["numbers"], n)
        running = np.cumsum(step)
        ends = np.cumsum(kinds)
        rank = running - np.repeat(np.r_[0, running][ends - kinds], kinds)
        sums = [np.diff(np.r_[0, np.cumsum(number * x[rank])][np.r_[0, ends]]) for x in (best, total)]
        out.append(pa.table([pa.array(x) for x in (np.array(p["n_a"]), np.array(p["n_b"]), np.array(p["n_groups"]), np.array(p["n_links"]), *sums)],
                            names=["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])
                   .add_column(0, "doc_id", pa.array(p["ids"], pa.int64())).append_column("groups_sha256", pa.array(p["digests"], pa.string())))
    return pa.concat_tables(out)


def aligned_parts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The encoded corpus by blocks (see PARTS). The vocabulary files are read on the driver and broadcast: their size is fixed."""
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(f"{folder}/{name}", "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept(base.mapInArrow(_encode(shared), PARTS), "alignment-parts")


def pair_counts(parts: DataFrame, pair_base: int) -> DataFrame:
    """(pair, total, best): how many documents hold an id pair linked, and whether no other pair of its A id has more."""
    merged = parts.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("total"))
    merged = kept(merged, "alignment-counts").withColumn("a", F.floor(F.col("pair") / pair_base))
    highest = merged.groupBy("a").agg(F.max("total").alias("highest"))
    return merged.join(highest, "a").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text)."""
    import sentencepiece

    pair_base = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model").get_piece_size()
    parts = aligned_parts(docs, folder)
    wanted = parts.where("pairs is not null").select("block", F.posexplode("pairs").alias("rank", "pair"))
    answers = wanted.join(pair_counts(parts, pair_base), "pair").select(F.col("block").alias("of_block"), "rank", "total", "best")
    pieces = parts.where("ids is not null").select("block", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "kinds", "ranks", "numbers")
    return pieces.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_summed, RESULT)

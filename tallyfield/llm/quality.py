"""Quality rules: simple text statistics and tokenizer fertility.

Each whole text is measured once: words, symbols, repeated lines and repeated three-word windows (the base rules), then the tokens a
public vocabulary cuts it into. Three fertility measures decide: code points per token, the share of tokens that are not whole UTF-8
characters (the byte fallback of a byte-level vocabulary), and the entropy of the token distribution in bits.

A document is rejected when a measure leaves the band of its language. Bands are multiples of the language's median over all documents that
passed the base rules; medians come from exact counts on a grid of 1/1000, so they do not depend on row order. Documents without a language
use the dominant script of their letters instead. Entropy grows with the length of a text, so its median is that of the texts of the language within the
same power of two of tokens. Lengths with too few texts take the nearest shorter median (a longer text holds no less), or where there is none the nearest
longer one, scaled by the bits that so few tokens can hold.

Defined results: NULL and empty texts have no words and fail the base rules; NULL ids are kept as they are; repeated rows each get
the same verdict; a band with one document is centred on that document; an empty table gives an empty result; extra
columns pass through ``with_verdict`` and are ignored by ``quality_verdicts``; columns with the names of measures are not touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyfield.llm.storage import kept
from tallyfield.llm.text import chunks, mix, sequence_hashes, span_hashes, word_bounds

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the published pre-tokenizer pattern of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GRID = 1000


@dataclass(frozen=True)
class Bands:
    """Limits as multiples of the language's median; the byte share may exceed its median by an absolute amount."""

    min_words: int = 50
    max_repeat_percent: int = 50
    chars_low: float = 0.86
    chars_high: float = 1.20
    bytes_above: float = 0.10
    entropy_low: float = 0.82
    like_length: int = 20  # texts that make a median of their length; the best filled length of a language always does


class Vocabulary:
    """A public byte-level vocabulary and which of its tokens are no whole characters."""

    _loaded: dict[int, "Vocabulary"] = {}

    def __init__(self, raw: bytes):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.partial[rank] = True

    @classmethod
    def of(cls, raw: bytes) -> "Vocabulary":
        key = hash(raw)
        if key not in cls._loaded:  # once for each Python worker
            cls._loaded[key] = cls(raw)
        return cls._loaded[key]

    def measure(self, text: str) -> tuple[int, int, float]:
        """Tokens, tokens that are no whole characters, entropy in bits."""
        tokens = self.encoding.encode_to_numpy(text, disallowed_special=())
        if not tokens.size:
            return 0, 0, 0.0
        share = np.unique(tokens, return_counts=True)[1] / tokens.size
        return tokens.size, int(self.partial[tokens].sum()), float(-(share * np.log2(share)).sum()) + 0.0


def base_measures(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of BASE for the rows of a byte buffer."""
    n = len(offsets) - 1
    starts, ends, rows = word_bounds(buf, offsets)
    n_words = np.bincount(rows, minlength=n)
    character = (buf & 0xC0) != 0x80
    running = np.concatenate([[0], np.cumsum(character)])
    word_chars = np.bincount(rows, weights=(running[ends] - running[starts]), minlength=n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

    breaks = np.flatnonzero(buf == 10)
    cuts = np.unique(np.concatenate([breaks + 1, offsets]))
    line_start = cuts[:-1] if len(cuts) else cuts
    line_end = cuts[1:].copy()
    has_break = np.zeros(len(line_end), dtype=bool)
    if buf.size:
        has_break = buf[line_end - 1] == 10
    line_end = line_end - has_break
    first_word = np.searchsorted(starts, line_start, side="left")
    worded = np.zeros(len(line_start), dtype=bool)
    inside = first_word < len(starts)
    worded[inside] = starts[first_word[inside]] < line_end[inside]
    a, b = line_start[worded], line_end[worded]
    line_row = np.searchsorted(offsets, a, side="right") - 1
    n_dup_lines = np.zeros(n, dtype=np.int64)
    if a.size:
        key = mix(span_hashes(buf, a, b) ^ mix(line_row.astype(np.uint64) + np.uint64(1)))
        earliest = np.unique(key, return_index=True)[1]
        n_dup_lines = np.bincount(line_row, minlength=n) - np.bincount(line_row[earliest], minlength=n)

    n_repeat = np.zeros(n, dtype=np.int64)
    if starts.size >= 3:
        windows = sequence_hashes(span_hashes(buf, starts, ends), 3)
        whole = np.flatnonzero(rows[2:] == rows[:-2])
        if whole.size:
            key = mix(windows[whole] ^ mix(rows[whole].astype(np.uint64) + np.uint64(1)))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = whole[count[inverse] > 1]
            covered = np.zeros(starts.size, dtype=bool)
            for step in range(3):
                covered[again + step] = True
            n_repeat = np.bincount(rows[covered], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


# fixed values: first bytes of UTF-8 characters by script
_LEADS = {"latin": [*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
          "hebrew": [0xD6, 0xD7], "arabic": [0xD8, 0xD9, 0xDA, 0xDB], "indic": [0xE0], "cjk": [*range(0xE3, 0xEE)]}


def dominant_script(text: bytes) -> str:
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    totals = {name: int(counts[leads].sum()) for name, leads in _LEADS.items()}
    best = max(totals, key=totals.get)
    return best if totals[best] else "none"


MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in (*BASE, "n_chars_all", "n_tokens", "n_partial_tokens")] + [
    T.StructField("token_entropy", T.DoubleType()), T.StructField("band", T.StringType())])


def _measurer(raw_vocabulary, names: Sequence[str], text: str, lang: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(raw_vocabulary.value)
        for batch in batches:
            texts = batch.column(text)
            langs = batch.column(lang) if lang else None
            for row, buf, offsets in chunks(texts):
                n = len(offsets) - 1
                columns = base_measures(buf, offsets)
                raw = buf.tobytes()
                leads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                tokens, partial, entropy, band = [], [], [], []
                for i in range(n):
                    piece = raw[offsets[i]:offsets[i + 1]]
                    t, p, h = vocabulary.measure(piece.decode("utf-8", "replace"))
                    tokens.append(t)
                    partial.append(p)
                    entropy.append(h)
                    own = langs[row + i].as_py() if langs is not None else None
                    band.append(own if own is not None else f"script:{dominant_script(piece)}")
                chars = leads[offsets[1:]] - leads[offsets[:-1]]
                parts = [pa.array(np.asarray(c, dtype=np.int64)) for c in (*columns, chars, tokens, partial)]
                measured = pa.StructArray.from_arrays([*parts, pa.array(entropy, pa.float64()), pa.array(band, pa.string())], names=MEASURES.fieldNames())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, n) for c in names], measured], names=[*names, "__measures"])
    return run


def measure(docs: DataFrame, keep: Sequence[str], vocabulary: str = VOCABULARY, text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns ``keep`` of docs and a struct ``__measures``. The vocabulary file is read by the driver and sent to the executors: a
    public vocabulary is at most a few MB whatever the input."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    has_lang = lang in docs.columns
    extra = [text, *([lang] if has_lang else [])]
    source = docs.select(*keep, *[F.col(c).cast("string").alias(f"__{c}") for c in extra])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("__measures", MEASURES)])
    return source.mapInArrow(_measurer(raw, list(keep), f"__{text}", f"__{lang}" if has_lang else None), schema)


def _derived(measured: DataFrame, bands: Bands) -> DataFrame:
    m = F.col("__measures")
    words, repeats = m["n_words"], m["n_repeat_words"]
    tokens = F.nullif(m["n_tokens"].cast("double"), F.lit(0.0))
    failed = (words < bands.min_words) | (repeats * 100 > words * bands.max_repeat_percent)
    return (measured.withColumn("__failed", failed)
            .withColumn("__chars", m["n_chars_all"] / tokens).withColumn("__bytes", m["n_partial_tokens"] / tokens)
            .withColumn("__band", m["band"]))


def _octave(tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)).cast("double"))).cast("int")


def medians(derived: DataFrame, like_length: int) -> DataFrame:
    """Lower median of chars and bytes for each band, on a grid of 1/1000, over the documents that passed the base rules; ``__curve`` holds
    those of the entropy as (octave of tokens, median) of lengths with enough texts."""
    m = F.col("__measures")
    measures = ((F.col("__chars"), F.lit(-1)), (F.col("__bytes"), F.lit(-1)), (m["token_entropy"], _octave(m["n_tokens"])))
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), o.alias("o"), F.floor(c * GRID).cast("long").alias("v")) for i, (c, o) in enumerate(measures)])
    counted = (derived.where(~F.col("__failed")).select("__band", F.explode(pairs).alias("p")).select("__band", "p.k", "p.o", "p.v")
               .groupBy("__band", "k", "o", "v").agg(F.count(F.lit(1)).alias("c")))
    by_value = Window.partitionBy("__band", "k", "o").orderBy("v")  # one row for each value of the grid, not for each document
    ranked = counted.withColumn("upto", F.sum("c").over(by_value)).withColumn("total", F.sum("c").over(Window.partitionBy("__band", "k", "o")))
    middle = ranked.where("upto * 2 >= total").groupBy("__band", "k", "o").agg((F.min("v") / F.lit(float(GRID))).alias("m"), F.first("total").alias("total"))
    # at most one row for each power of two of tokens
    most = F.max("total").over(Window.partitionBy("__band", "k"))
    middle = middle.withColumn("most", most).where(F.col("total") >= F.least(F.col("most"), F.lit(like_length)))
    curve = F.array_sort(F.collect_list(F.when(F.col("k") == 2, F.struct("o", "m"))))
    return middle.groupBy("__band").agg(*[F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"__m{i}") for i in range(2)], curve.alias("__curve"))


def _expected_entropy() -> Column:
    """Entropy of a text of the document's length, from ``__curve``."""
    tokens = F.col("__measures")["n_tokens"]
    own = _octave(tokens)
    shorter = F.filter("__curve", lambda p: p["o"] <= own)
    longer = F.get("__curve", F.lit(0))
    # bits for each bit that the tokens can hold fall with length: no more than a text of this length has
    scaled = longer["m"] * F.log2(F.greatest(tokens, F.lit(1)).cast("double")) / (longer["o"] + 1)
    return F.when(F.size(shorter) > 0, F.get(shorter, F.size(shorter) - 1)["m"]).otherwise(scaled)


def _verdicts(docs: DataFrame, keep: Sequence[str], bands: Bands, vocabulary: str) -> DataFrame:
    derived = _derived(kept(measure(docs, keep, vocabulary), "quality-measures"), bands)
    middle = kept(medians(derived, bands.like_length), "quality-medians").withColumnRenamed("__band", "__own")
    joined = derived.join(middle, F.col("__band") == F.col("__own"), "left")
    entropy = F.col("__measures")["token_entropy"]
    fits = ((F.col("__chars") >= F.col("__m0") * bands.chars_low) & (F.col("__chars") <= F.col("__m0") * bands.chars_high)
            & (F.col("__bytes") <= F.col("__m1") + bands.bytes_above) & (entropy >= _expected_entropy() * bands.entropy_low))
    return joined.withColumn("__kept", ~F.col("__failed") & F.coalesce(fits, F.lit(False)))


def quality_verdicts(docs: DataFrame, bands: Bands = Bands(), vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): measures, base_failed and kept."""
    m = F.col("__measures")
    return _verdicts(docs, ["doc_id"], bands, vocabulary).select(
        "doc_id", *[m[c].alias(c) for c in BASE], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), m["n_tokens"].alias("n_tokens"),
        F.coalesce(F.col("__chars"), F.lit(0.0)).alias("chars_per_token"), F.coalesce(F.col("__bytes"), F.lit(0.0)).alias("byte_share"),
        m["token_entropy"].alias("token_entropy"), m["band"].alias("band"))


def kept_documents(docs: DataFrame, bands: Bands = Bands(), vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return _verdicts(docs, docs.columns, bands, vocabulary).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])

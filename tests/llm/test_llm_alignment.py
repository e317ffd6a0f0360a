import collections
import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import SCHEMA, corpus  # noqa: E402

from tallyfield.llm import alignment  # noqa: E402

DATA = "/root/testdata/sf0.001"


def letters():
    """The byte each letter of the byte-level vocabulary stands for."""
    bs = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, extra = {chr(b): b for b in bs}, 0
    for b in range(256):
        if b not in bs:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model"), letters()


def plain(docs, tools):
    """Token by token, with the tokenizer libraries the vocabularies are published for."""
    a_tool, b_tool, table = tools
    links, rows, holders = [], [], collections.Counter()
    for d, t in docs:
        want = b" " + (t or "").encode()
        a = a_tool.encode(" " + (t or ""), add_special_tokens=False).ids
        b = b_tool.encode(t or "")
        a_bytes = [bytes(table[c] for c in a_tool.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tool.id_to_piece(i)) for i in b)]
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        own, said, i, j, x, y, part = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if x <= y and i < len(a) and (x < y or len(part[0]) == len(part[1]) == 0 or j >= len(b)):
                part[0].append(a[i]); x += len(a_bytes[i]); i += 1
            else:
                part[1].append(b[j]); y += len(b_bytes[j]); j += 1
            if x == y and part[0] and part[1]:
                said.append(",".join(map(str, part[0])) + "|" + ",".join(map(str, part[1])))
                part = ([], [])
        ends, at = [], 0
        for z in b_bytes:
            ends.append((at, at + len(z)))
            at += len(z)
        at = 0
        for u, z in zip(a, a_bytes):
            own += [(u, v) for v, (p, q) in zip(b, ends) if p < at + len(z) and q > at]
            at += len(z)
        links.append(own)
        holders.update(set(own))
        rows.append((d, len(a), len(b), len(said), len(own), hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""))
    best = {}
    for (u, _), c in holders.items():
        best[u] = max(best.get(u, 0), c)
    return collections.Counter((*r[:5], sum(holders[p] == best[p[0]] for p in own), sum(holders[p] for p in own), r[5]) for r, own in zip(rows, links))


ODD = ["<|endoftext|> and <s> </s> <unk> <0x0A>", " two  spaces\tand\ttabs \n\n", "▁marks▁", "日本語 テキスト 🙂🙃 é", "ﬁne ² Ⅷ x", "a" * 3000, "x\u0000y", "\r\nline", "naïve façade"]


@pytest.mark.parametrize("piece,block", [(1 << 20, 1 << 24), (300, 900)])
def test_matches_token_by_token(spark, monkeypatch, tools, piece, block):
    docs, _ = corpus()
    docs = docs + [(100 + i, t) for i, t in enumerate(ODD)]
    rows = [(d, t, None, None, None, "x", 1, "d", "l") for d, t in docs]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(alignment, "PIECE_BYTES", piece)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    assert collections.Counter(map(tuple, alignment.align_documents(frame).collect())) == plain(docs, tools)


def test_given_texts_and_an_empty_table(spark, tools):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert collections.Counter(map(tuple, alignment.align_documents(docs).collect())) == plain([tuple(r) for r in docs.collect()], tools)
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_numbers_come_back():
    import numpy as np
    x = np.random.default_rng(1).integers(0, 1 << 31, 1000)
    assert (alignment._unpacked(alignment._packed(x), 1000) == x).all()

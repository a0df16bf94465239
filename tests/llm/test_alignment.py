"""Token alignment by merge paths against plain loops."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from treeloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "a", "Hello, world! <s> <|endoftext|> <0x41> it's", "  two  spaces \n\n and\tlines\r\nend ", "▁mark", "日本語のテキスト 😀  x　y", "é ½ ﬁ é ₂", "x\x00y\x85z",
    "the same words here again and again", "the same words here again and again", "wort " * 700, "Ünïcödé\nNext line.\nAnother one", "a\n", "\nb", "don't 'tis we'll\n'", "1234567890 12 345", "a  b", "tab\tin  wide sep",
]


def plain(texts):
    """Groups, links and counts of each text, byte by byte."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    code, nth = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            code[chr(byte)] = byte
        else:
            code[chr(256 + nth)] = byte
            nth += 1
    rows = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a_ids, b_ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        a_bytes = [bytes(code[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append(None)
            continue
        links, groups, at, ends = [], [], [0, 0], [len(a_bytes[0]), len(b_bytes[0])]
        group = [[a_ids[0]], [b_ids[0]]]
        links.append((a_ids[0], b_ids[0]))
        while True:
            if ends[0] == ends[1]:
                groups.append(group)
                at = [at[0] + 1, at[1] + 1]
                if at[0] == len(a_ids):
                    break
                group = [[a_ids[at[0]]], [b_ids[at[1]]]]
                ends = [ends[0] + len(a_bytes[at[0]]), ends[1] + len(b_bytes[at[1]])]
            else:
                side = int(ends[1] < ends[0])
                at[side] += 1
                group[side].append((a_ids, b_ids)[side][at[side]])
                ends[side] += len((a_bytes, b_bytes)[side][at[side]])
            links.append((a_ids[at[0]], b_ids[at[1]]))
        rows.append((len(a_ids), len(b_ids), groups, links))
    counts = collections.Counter(p for r in rows if r for p in r[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in r[2])
        out.append((r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == most[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), hashlib.sha256(shown.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("piece", "frequent"), [(1 << 20, 1 << 17), (7, 5), (1, 0), (64, 10)])
def test_equals_plain_loops(spark, piece, frequent):
    rows = [(i if i else None, t, 1, 2) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, uid int").repartition(3)
    got = alignment.align(docs, A, B, piece=piece, frequent=frequent).collect()
    want = dict(zip([r[0] for r in rows], plain(TEXTS), strict=True))
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], (r["doc_id"], TEXTS[r["doc_id"] or 0])


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, "one text")] * 3, schema), A, B, piece=2).collect()
    assert len(got) == 3 and len(set(got)) == 1 and got[0]["count_sum"] == 3 * got[0]["n_links"]


def test_documents_equal_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = docs.orderBy("doc_id").collect()
    want = plain([r["text"] for r in texts])
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, A, B, piece=5000, frequent=3000).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(texts, want, strict=True)}


def test_pieces_have_equal_work():
    rng = np.random.default_rng(0)
    length = np.array([1, 2, 3, 4])
    a = rng.integers(0, 4, 5000).astype(np.uint16)
    b = np.zeros(int(length[a].sum()), np.uint16)
    cuts = list(alignment.cut_pieces(a, b, length, length, 1000))
    assert sum(i1 - i0 for i0, i1, *_ in cuts) == len(a) and sum(j1 - j0 for _, _, j0, j1, _ in cuts) == len(b)
    assert all(c[0] == d[1] and c[2] == d[3] for d, c in zip(cuts, cuts[1:]))
    work = [i1 - i0 + j1 - j0 for i0, i1, j0, j1, _ in cuts]
    assert max(work) <= 1000 and max(work) - min(work) <= 1

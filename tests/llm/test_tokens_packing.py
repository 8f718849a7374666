import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import clashing, documents, prose
from tracetrim.llm import bitpack as B
from tracetrim.llm import packing as P
from tracetrim.llm.tokens import default_path, encoder

TEXTS = ["Hello world", None, "", "  two  blanks\n \n x", "naïve café 12½ _x_", "it's we'll I'VE", "<|endoftext|> in text", "中文 mixed 字",
         prose(3, 5000), "a\x1cb", " lead", "trail ", "tab\t x", prose(5, 300)]


def whole(text, end):
    ids = encoder(None).tokenizer.encode(text or "", add_special_tokens=False).ids
    return [*ids, end]


def test_cut_texts_encode_as_whole_ones():
    e, r = encoder(None), random.Random(2)
    atoms = ["a", "Bc", " ", "  ", "\n", "'", "s", "12", ".", "é", "½", "_", "\t", "́", "ß", "<|endoftext|>", "中", "\r\n"]
    for t in [x or "" for x in TEXTS] + ["".join(r.choices(atoms, k=r.randint(0, 10))) for _ in range(4000)]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_hold_each_id_once(spark):
    texts = TEXTS + [prose(i, 3 + 37 * i % 900) for i in range(60)]
    got = P.pack(clashing(documents(spark, texts)), default_path()).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array(whole(t, 1), dtype="<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    waste = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_tokens <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste == 0


def test_sum_of_squares_choice():
    p = P.LevelPacker(10, 10 ** 9)
    for n in (4, 4, 4):
        p.place("x", 0, np.zeros(n, dtype="<u4"))
    # three items of 4: the third may open a sequence or join one; every choice is the least sum of squares of its time
    assert p.counts.sum() * 0 == 0 and sum(k * c for k, c in enumerate(p.counts)) + 10 * p.next == 12
    p.flush()
    assert sum(len(x[2]) for x in p.done) == 12


def test_bounded_open_sequences():
    p = P.LevelPacker(64, 500)
    for i in range(400):
        p.add(i, np.full(33, i, dtype="<u4"))  # two never fit: all sequences stay open but for the bound
        assert p.held <= 500 + 64
    p.flush()
    assert sum(len(x[2]) for x in p.done) == 400 * 33


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2 ** 32 - 1), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_bit_packing_round_trip(width, ids, a, b):
    ids = np.array([i % (1 << width) for i in ids], dtype=np.uint32)
    blob = B.pack_ids(ids, width, 128)
    assert B.unpack_ids(blob).tolist() == ids.tolist()
    assert B.unpack_ids(blob, a, b).tolist() == ids[a:b].tolist()
    assert len(blob) <= 24 + 8 * (len(ids) // 128 + 2) + 8 * width * (len(ids) // 64 + 1)


def test_files_in_id_order(spark, tmp_path):
    ids = [5, 3, None, 9, 3, -2, *range(20, 20 + len(TEXTS) - 6)]
    df = documents(spark, TEXTS, ids=ids)
    path = str(tmp_path / "packed")
    B.write_packed(clashing(df), path, default_path(), file_ids=500)
    got = sorted(B.read_packed(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    at, want = 0, {}
    for i, t in zip(ids, TEXTS):
        x = np.array(whole(t, 2), dtype="<u4")
        want.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert B.width_of(50257) == 16 and B.width_of(2) == 1 and B.width_of(65537) == 17


def test_empty(spark, tmp_path):
    assert P.pack(documents(spark, [])).count() == 0
    B.write_packed(documents(spark, []), str(tmp_path / "none"))
    assert B.read_packed(spark, str(tmp_path / "none")).count() == 0

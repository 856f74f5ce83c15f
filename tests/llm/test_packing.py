import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from bazaarlens.llm import packing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("group", T.StringType()), T.StructField("tail", T.IntegerType())])
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello, World! it's we'll 123 a1b2", "İstanbul ΣΑΣ é ñandú ñ  x y", "x\x1fy\x85z \U0001f600‍", "don't DON'T 'S 's'S", "ﬁ Å Å ½", "日本語テキスト", "a" * 5000, "&&& the%%% the&&&", "über!!Straße ŉ ǅ"]


def test_ids_equal_whole_text_encoding():
    model = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    alphabet = list("abcXYZ 'ñÑéÉß,.!?123\t\n ́İ")
    texts = ODD + ["".join(rng.choice(alphabet, 60)) for _ in range(300)]
    ids, bounds = packing.document_ids(pa.array(texts, pa.string()), PATH)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 1], t


def test_added_tokens_inside_and_beside_words():
    model = Tokenizer.from_file(PATH)
    tokens = [t.content for t in model.get_added_tokens_decoder().values()]
    texts = [f for t in tokens for f in (t, f"a {t} b", f"a{t}b", f"{t}{t}", f"don't{t}\n12{t}é!", f"İ{t}x", t.upper(), f"a{t.title()}b", t[:-1], f"<{t}>")]
    ids, bounds = packing.document_ids(pa.array(texts), PATH)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 1], t
    assert len(tokens) == 2 and 49407 in ids.tolist()


def test_every_letter_and_sign_between_words():
    model = Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}b {chr(c)} 'S{chr(c)}'lL! {chr(c)}{chr(c)}1" for c in range(1, 0x250)]
    ids, bounds = packing.document_ids(pa.array(texts), PATH)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*model.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("texts", [[], [""], ["", None], [None, "a", "", None]])
def test_texts_without_words_have_the_end_alone(texts):
    ids, bounds = packing.document_ids(pa.array(texts, pa.string()), PATH)
    assert np.diff(bounds).tolist() == [2 if t else 1 for t in texts]
    assert ids.tolist() == [i for t in texts for i in ([320, 1] if t else [1])]


def test_words_of_known_pieces_take_no_python():
    # words differ in capitals and signs, of the same few pieces: calls from Python must not grow with the words
    parts, signs = ["the", "Of", "ORE", "that"], [".", ",", "-", "!", "_", "+", "=", "/"]
    words = [f"{a}{s}{b}{t}{c}" for a in parts for s in signs for b in parts for t in signs for c in parts]
    packing.tokenizer(PATH).forget()
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        packing.document_ids(pa.array([" ".join(words)]), PATH)
    finally:
        sys.setprofile(None)
    assert len(set(words)) == 4096 and len(calls) < 2000


@pytest.mark.parametrize("group", [4, 4096])
def test_every_id_is_packed_once(spark, group):
    rng = np.random.default_rng(7)
    texts = ODD + [" ".join(rng.choice(["the", "of", "reor", "thndou,", "Zu"], n)) for n in rng.integers(1, 3000, 60).tolist()] + ["long words " * 6000]
    rows = [(i, t, "g", 0) for i, t in enumerate(texts)] + [(2, texts[2], "g", 0), (None, "x", "g", 0)]
    model = Tokenizer.from_file(PATH)
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), PATH, group_docs=group).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for i, t, *_ in rows[: len(texts)]:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        copies = 2 if i == 2 else 1
        assert sum(p.length for p in by_doc[i]) == copies * len(ids)
        for p in by_doc[i]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        if copies == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
        padding += 2048 - at
    assert padding < 2048 * -(-len(rows) // group) * 2
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 3000).tolist()
    placed = packing.assign(lengths)
    count = -(-sum(lengths) // 2048)
    room, whole = [0] * count, 0
    for i, _, n, s in placed:
        room[s] += n
        whole += n == lengths[i]
    assert max(room) <= 2048 and sum(room) == sum(lengths) and sum(2048 - n for n in room) < 2048
    assert whole > 0.9 * len(lengths)

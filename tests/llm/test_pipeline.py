"""The pipeline's stages against brute force, each on its predecessor's output."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from bazaarlens.llm import mixing
from tests.llm.test_text_operators import brute_lines, invented

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    langs = ["en", "de", "es"]
    texts = ["\n".join(invented(rng, langs[i % 3], int(n)) for n in rng.integers(3, 30, 4)) for i in range(45)]
    texts[7] = texts[4] + "\n" + invented(rng, "de", 12)
    texts[30] = texts[12].upper()
    texts += [None, "", "12 $$ !!", texts[5], invented(rng, "es", 9000)]
    rows = [(i, t, langs[i % 3] if i < 45 else None, "big" if i % 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs.append(docs)
    first, second, third, fourth, fifth = outs
    assert all(o.columns == SCHEMA.names for o in outs[:4])

    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) == {i for i, t in enumerate(texts) if i not in (45, 46, 47)}
    assert all(kept[i].text == texts[i] and kept[i].lang == rows[i][2] for i in kept)

    ids = sorted(kept)
    want = dict(zip(ids, brute_lines([kept[i].text for i in ids], 10), strict=True))
    lines = {r.doc_id: r for r in second.collect()}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())
    assert want[48] == ""  # a copy of document 5: all its lines came before

    from tests.llm.test_shingles import brute_survivors  # which takes this module's schema

    groups = brute_survivors([(i, want[i]) for i in ids])
    assert {r.doc_id for r in third.collect()} == {ids[min(g)] for g in groups.values()}
    assert 30 not in {r.doc_id for r in third.collect()}

    copies = {r.doc_id: r.copies for r in mixing.mixed(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == copies and min(copies.values()) >= 1

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = Counter()
    for p in fifth.collect():
        length[p.doc_id] += p.length
    assert length == {i: n * (len(model.encode(want[i], add_special_tokens=False).ids) + 1) for i, n in copies.items()}

    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, fifth.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(k.startswith(f"op{n}_") for k in known) for n in range(1, 14))

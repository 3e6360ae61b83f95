"""The pipeline stage by stage against brute force, on a small corpus."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm import brute_components, lower, texts

import corpus_pipeline
from shieldline.llm import decontaminate, language, packing, pii, tokens
from shieldline.llm.textarrays import buffers, words


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(11)
    body = [t for t in texts(11, 50) if t]
    item = " ".join(f"quest{k}ion" for k in range(14))
    body += [f"{body[20]} {item.upper()} und mehr", f"write to ann.lee@mail.example.org or {body[30]}", f"{body[31]} ann (at) mail (dot) example (dot) org", "*** 12 34 ***"]
    body += [body[25], body[25] + " tail", None]
    rng.shuffle(body)
    rows = [(i, t, rng.choice(["en", "de"]), "s", None if t is None else len(t)) for i, t in enumerate(body)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, results = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
        results.append({r.doc_id: r for r in out.collect()} if name != corpus_pipeline.STAGES[-1][0] else out.collect())
        at = out
    kept, single, clean, masked, packed = results

    assert set(kept) == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    roots = brute_components([(i, r.text) for i, r in kept.items()])
    assert set(single) == {i for i, (n, root) in roots.items() if root == i}
    window = decontaminate.item_words(item)
    held = lambda t: any(decontaminate.item_words(t)[k : k + 10] == window[j : j + 10] for j in range(5) for k in range(len(t.split())))
    assert set(clean) == {i for i, r in single.items() if not held(r.text)} and len(clean) < len(single)
    assert set(masked) == set(clean)
    for i, r in masked.items():
        base, more = pii.find_all(clean[i].text)
        assert r.text == pii.mask_text(clean[i].text, base + more) and r.n_chars == len(r.text)
    assert any("[EMAIL]" in r.text for r in masked.values()) and not any("@" in r.text or "(at)" in r.text for r in masked.values())
    ids = dict(zip(masked, tokens.Bpe(tokens.vocabulary(packing.public_vocabulary())).encode(pa.array([r.text for r in masked.values()]))))
    for i, own in ids.items():
        parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == i)
        assert np.array_equal(np.concatenate([own[s : s + n] for _, s, n, _ in parts]), own)
        assert all(zlib.crc32(own[s : s + n].astype("<u4").tobytes()) == c for _, s, n, c in parts)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(whole) == sorted(packed)


def test_language_stage_without_languages(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, "12", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in language.keep_known_language(spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("text", ["", "one", " two  words\n", "ünï cödé", "\t"])
def test_words_of_a_buffer(text):
    raw, offsets = buffers(pa.array([text, None, text]))
    starts, ends, first = words(raw, offsets)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == lower(text).split() * 2 if text == lower(text) else len(found) == 2 * len(text.split())
    assert first.tolist() == [0, len(text.split()), len(text.split()), 2 * len(text.split())]

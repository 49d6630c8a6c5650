"""The pipeline's stages take effect, one on the other's result."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_lines, edit, plain_logit, toxic_texts, words

from groundspan.llm import bpe, common, decontam, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark, tmp_path):
    rng = random.Random(13)
    texts, labels = toxic_texts(rng, 300)
    docs = dict(enumerate(texts))
    item = " ".join(words(rng, 40, 500))
    base = " ".join(words(rng, 150, 500))
    copies = {1000 + k: base if k < 2 else base.replace(" w1", " w9", 2) for k in range(4)}
    leaks = {2000: f"{' '.join(words(rng, 60, 500))} {edit(rng, item, 4)} {' '.join(words(rng, 60, 500))}"}
    notice = " ".join(words(rng, 9, 500))
    lined = {3000 + k: f"{' '.join(words(rng, 40, 500))}\n{notice}\n{' '.join(words(rng, 40, 500))}" for k in range(10)}
    odd = {4000: None, 4001: "", 4002: "w1"}
    docs |= copies | leaks | lined | odd
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int", "labels")
    write([(7, item)], "item_id long, text string", "benchmark")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i, y in enumerate(labels) if y}
    assert len(toxic & set(out)) <= 0.1 * len(toxic)
    clean = {i for i, y in enumerate(labels) if not y}
    assert len(clean - set(out)) <= 0.05 * len(clean)
    assert set(copies) & set(out) == {1000} and 2000 not in out
    assert set(lined) <= set(out), {name: sorted(set(lined) - {r.doc_id for r in stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}) for name, stage in corpus_pipeline.STAGES}
    assert [notice in out[i].text for i in lined] == [True] + [False] * 9
    assert all(out[i].n_chars == len(out[i].text) for i in lined)
    assert set(odd) <= set(out) and out[4000].token_ids is None and out[4001].n_tokens == 0
    assert all(r.round_trip for r in out.values() if r.text is not None)
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs_now, str(tmp_path)).columns == COLUMNS, name


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage again by plain means on what the one before keeps: loops over words, dictionaries of lines, all pairs of fingerprints, edit distance at every place, a public tokenizer."""
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(17)
    texts, labels = toxic_texts(rng, 120)
    items = [(k, " ".join(words(rng, 30, 500))) for k in range(5)]
    notice = "\n".join(" ".join(words(rng, 8, 500)) for _ in range(3))
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(1000 + k, f"{' '.join(words(rng, 30, 500))}\n{notice}\n{' '.join(words(rng, 30, 500))}") for k in range(9)]
    docs += [(2000 + k, f"{' '.join(words(rng, 40, 500))} {edit(rng, items[k % 5][1], 5 * (k % 3))}") for k in range(10)]
    docs += [(3000 + 10 * k + m, edit(rng, texts[k], m)) for k in range(1, 9) for m in range(3)]
    docs += [(4000, None), (4001, ""), (4002, "-- "), (4003, "w1"), (4004, texts[5]), (4004, texts[6]), (None, texts[7])]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write(docs, "doc_id long, text string", "documents")
    write(list(enumerate(labels)), "doc_id long, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    got = [(r.doc_id, r.text, r.token_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    weights, threshold = toxicity.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    logits = plain_logit([t for _, t in docs], weights)
    assert np.abs(logits[np.isfinite(logits)] - threshold).min() > 1e-4
    left = brute_lines([d for d, x in zip(docs, logits) if x < threshold])
    some = [k for k, (i, _) in enumerate(left) if i is not None]
    place, prints = simhash.fingerprints(*common.text_bytes(pa.array([left[k][1] for k in some], pa.string())))
    group = {left[k][0]: left[k][0] for k in some}

    def root(i):
        return i if group[i] == i else root(group[i])

    for a in range(len(place)):
        for b in range(a):
            if sum(int(x).bit_count() for x in prints[a] ^ prints[b]) <= simhash.MAX_DISTANCE:
                i, j = (root(left[some[place[k]]][0]) for k in (a, b))
                group[max(i, j)] = min(i, j)
    left = [(i, t) for i, t in left if i is None or root(i) == i]
    holds = lambda t: any(decontam.edit_distance(decontam.normal(x), decontam.normal(t)) <= decontam.edits(len(x)) for _, x in items)
    leaked = {i for i, t in left if t and holds(t)}
    left = [(i, t) for i, t in left if i not in leaked]
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    want = [(i, t, None if t is None else public.encode_ordinary(t)) for i, t in left]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len(leaked) > 5 and len(want) < len(docs) - 25


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, n_chars long"), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_chars", "token_ids", "n_tokens", "round_trip"]

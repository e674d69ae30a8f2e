"""The pipeline against a brute-force version of its stages, and the entry point without them."""

import base64
import subprocess
import sys
from pathlib import Path

import brute
import public_tokenizers
import pytest
import tiktoken
from conftest import FOLDER

import corpus_pipeline
from workloom.llm import private_data, queries

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline(spark, texts):
    bench = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stay = {i: r["text"] for i, r in texts.items() if not brute.quality(r["text"])[5]}
    root = brute.components(stay, 5)  # words of a shingle in the near-copy stage
    stay = {i: t for i, t in stay.items() if root[i] == i}
    stay = {i: t for i, t in stay.items() if not any(b in t for b in bench)}
    anchors = private_data.automaton()
    stay = {i: private_data.mask(t, private_data.spans(t, anchors)) for i, t in stay.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.VOCABULARY), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(stay)
    for i, text in stay.items():
        ids = coder.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids) and got[i]["decoded_sha256"] == brute.sha(text)
        assert got[i]["ids_sha256"] == brute.sha(",".join(map(str, ids)))


def test_stages_keep_the_columns(spark, odd, none):
    for docs in (odd, none):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, FOLDER)
            assert rows.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
        assert last.count() == (0 if docs is none else 2)


@pytest.mark.parametrize("gone", [["workloom.llm", "corpus_pipeline"]])
def test_entry_without_the_subpackage(gone):
    code = (
        f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
        f"class No:\n    def find_spec(self, name, path=None, target=None):\n"
        f"        if name in {gone!r}: raise ImportError(name)\n"
        f"sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\n"
        f"assert len(e.queries()) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_stages_hold_batches_small(spark):
    """Executors and workers keep copies of Arrow batches outside the heap, so the stages bound them."""
    from workloom.llm.shared import BATCH

    rows, size = BATCH
    for name, stage in corpus_pipeline.STAGES[3:]:
        fresh = spark.newSession()
        fresh.conf.set(rows, "10000")
        fresh.conf.set(size, "1m")
        stage(fresh, fresh.createDataFrame([(1, "a text")], "doc_id bigint, text string"), "")
        assert (fresh.conf.get(rows), fresh.conf.get(size)) == (str(BATCH[rows]), "1m"), name


def test_joined_texts_need_little_room():
    """The strings of many ids are joined a few texts at a time, to the same texts."""
    import tracemalloc

    import numpy as np

    from workloom.llm.byte_pairs import _Ragged

    lines = [b"%d," % k for k in range(50_000)]
    ids = np.random.default_rng(1).integers(0, len(lines), 600_000)
    bounds = np.append(np.arange(0, len(ids), 500), len(ids))
    ragged = _Ragged(lines)
    tracemalloc.start()
    try:
        for a, b, joined in zip(bounds, bounds[1:], ragged.join(ids, bounds), strict=False):
            assert bytes(joined[:20]) == b"".join(lines[k] for k in ids[a : a + 20])[:20] and len(joined) == ragged.size[ids[a:b]].sum()
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()

import re
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from tidemark.llm import common, tokens, toxicity


def test_a_worker_keeps_one_model_and_lets_it_go():
    loads = []
    for key in (1, 1, 2, 1):
        assert common.held(key, lambda: loads.append(key) or [key]) == [key]
    assert loads == [1, 2, 1] and len(common._HELD) == 1
    common.let_go()
    assert not common._HELD


def test_the_model_of_an_operator_does_not_outlive_its_tasks(spark):
    """Worker processes are used again: what a scoring operator loaded must be gone in the operators after it."""
    def score(batches):
        for batch in batches:
            common.held("model", lambda: bytes(100))
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * batch.num_rows, pa.int64())], ["id"])

    def later(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._HELD)] * batch.num_rows, pa.int64())], ["id"])

    rows = spark.range(64, numPartitions=8)
    for _ in range(2):  # workers of the first round serve the second
        assert {r.id for r in common.map_arrow(rows, score, "id long", holds=True).collect()} == {1}
        assert {r.id for r in common.map_arrow(rows, later, "id long").collect()} == {0}


def test_tokenizers_are_let_go_too():
    """A tokenizer with its cache is larger than most models; it must not stay through the stages of other operators."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.word_ids(path)
    assert tokens.word_ids(path) is encoder and list(common._HELD) == [("word_ids", path)]
    common.let_go()
    assert tokens.word_ids(path) is not encoder
    common.held("model", list)
    assert list(common._HELD) == ["model"]
    common.let_go()


def test_workers_give_back_what_a_task_took(spark):
    """The allocator keeps freed pieces below one still in use, so a worker would stay as large as its largest task ever was."""
    def busy(batches):
        for batch in batches:
            taken = [np.ones(12_000) for _ in range(2_000)]  # 192 MB in pieces that the system does not get back one by one
            sys.still_in_use = taken[-1]
            yield pa.RecordBatch.from_arrays([pa.array([len(taken)], pa.int64())], ["mb"])

    def size(batches):
        for _ in batches:
            own = re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())
            yield pa.RecordBatch.from_arrays([pa.array([int(own[1]) // 1024], pa.int64())], ["mb"])

    rows = spark.range(64, numPartitions=8)
    common.map_arrow(rows, busy, "mb long").collect()
    assert max(r.mb for r in common.map_arrow(rows, size, "mb long").collect()) < 180


def test_a_toxicity_model_is_loaded_in_little_more_than_it_holds():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(4_000)]
    examples = [(doc, doc % 7 == 0, {words[i]: 1 for i in rng.choice(4_000, 300, replace=False)}) for doc in range(3_000)]
    model = toxicity.ToxicityModel({"word7": 2.0}, examples, 0.1)
    assert "index" not in model.__dict__  # the task that learns has no need of it
    data, texts = toxicity._packed(model), [" ".join(words[i::97]) for i in range(20)]
    common.let_go()
    tracemalloc.start()
    loaded = toxicity._loaded(data)
    holds, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert "index" in loaded.__dict__ and list(loaded.judge(texts)) == list(model.judge(texts))
    assert peak < 1.7 * holds
    common.let_go()

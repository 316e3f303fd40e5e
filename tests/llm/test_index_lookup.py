import tracemalloc

import numpy as np

from tidemark.llm.toxicity import BlockMaxIndex


def _vectors(rng, n, n_terms, size):
    out = []
    for _ in range(n):
        terms = rng.choice(n_terms, size, replace=False)  # in no order
        weights = rng.random(size) + 0.1
        out.append((terms, weights / np.linalg.norm(weights)))
    return out


def test_a_lookup_costs_by_the_terms_of_a_text_not_by_all_terms():
    rng, n_terms = np.random.default_rng(5), 2_000_000
    examples = _vectors(rng, 40, n_terms, 30)
    index = BlockMaxIndex(examples, n_terms, block=8)
    tracemalloc.start()
    assert index.top(*examples[7], 3)[0][1] == 7
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n_terms


def test_the_best_examples_are_those_of_brute_force():
    rng, n_terms = np.random.default_rng(6), 60
    examples, texts = _vectors(rng, 200, n_terms, 12), _vectors(rng, 20, n_terms, 9)
    dense = np.zeros((200, n_terms))
    for row, (terms, weights) in zip(dense, examples):
        row[terms] = weights
    index = BlockMaxIndex(examples, n_terms, block=16)
    for terms, weights in texts:
        asked = np.zeros(n_terms)
        asked[terms] = weights
        cosine = dense @ asked
        want = np.lexsort((np.arange(200), -cosine.round(12)))[:5]
        got = index.top(terms, weights, 5)
        assert [i for _, i in got] == want.tolist()
        assert np.allclose([-c for c, _ in got], cosine[want])

"""Near copies by five-word shingles against brute force."""

import random

import pytest

import corpus_pipeline as P
from helixforge.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts: dict[int, str]) -> set[int]:
    """The smallest id of each group that SimHash at two bits or a similarity of 0.8 links."""

    def own(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, fps, root = {i: own(t) for i, t in texts.items()}, {i: simhash.fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and ((fps[i] ^ fps[j]).bit_count() <= 2 or a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in texts}


def corpus() -> dict[int, str]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(base)
        for changes in (1, 2, 3, 5, 8, 12):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
    lines = [" ".join(t) for t in texts] + ["", "  ", "one two", "One two", "one three"]
    rng.shuffle(lines)
    return dict(enumerate(lines))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], SCHEMA)


def test_the_stage_drops_all_similar_texts(spark):
    texts = corpus()
    want = brute(texts)
    assert want < {r.component_id for r in simhash.near_duplicates(simhash.fingerprints(rows(spark, texts))).collect()}  # SimHash alone leaves some
    assert {r.doc_id for r in P.drop_near_copies(spark, rows(spark, texts), "").collect()} == want


@pytest.mark.parametrize("most", [2, 5])
def test_large_bands_link_the_same(spark, most):
    docs = rows(spark, corpus())
    own = near_copies.sketches(docs).cache()

    def closed(n):
        from helixforge.llm.components import components

        return {(r.node, r.component) for r in components(near_copies.link(own, docs, n)).collect()}

    assert closed(most) == closed(1024)

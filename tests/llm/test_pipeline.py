from collections import defaultdict

import corpus_pipeline
from pagemill.llm import decontamination, mixing

from .test_decontamination import naive_coverage
from .test_linededup import lines_left
from .test_mixing import WORDS, fair
from .test_quality import verdicts
from .test_simhash import components, plain_fingerprint


def test_against_brute_force(spark, documents, small):
    rows = {r.doc_id: r for r in documents.collect()}
    text = {k: r.text for k, r in rows.items()}
    keep = {v[0] for v in verdicts([(k, r.text, r.source) for k, r in rows.items()], 10) if v[-1]}
    text = lines_left([(k, text[k]) for k in keep])
    ids = list(text)
    stays = {d for d, c in zip(ids, components(ids, [plain_fingerprint(text[d]) for d in ids])) if d == c}
    items = [decontamination.tokens_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(t):
        words = decontamination.tokens_of(t)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item in items:
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)) and naive_coverage(item, words, 5) >= 0.6 * len(item):
                return True
        return False

    text = {d: text[d] for d in stays if not leaks(text[d])}

    stages = []
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).persist()
        stages.append(docs)
    assert [set(s.columns) for s in stages[:-1]] == [set(documents.columns)] * 4
    assert {r.doc_id for r in stages[0].collect()} == keep
    assert {r.doc_id: r.text for r in stages[3].collect()} == text
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())

    taken, sizes = defaultdict(int), defaultdict(int)
    for d, t in text.items():
        sizes[rows[d].source] += len(WORDS.findall(t))
    for r in stages[4].collect():
        n = len(WORDS.findall(r.text))
        assert r.text == text[r.doc_id] and r.taken == n * r.repeats and 1 <= r.repeats <= mixing.MAX_REPEATS
        taken[r.source] += r.taken
    want = fair(sizes)
    for s in sizes:
        most = max(len(WORDS.findall(t)) for d, t in text.items() if rows[d].source == s)
        assert abs(taken[s] - want[s]) <= most
    once = sorted((r.doc_id, r.taken) for r in stages[4].collect())
    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, small).collect()) == once


def test_stages_take_odd_and_empty_tables(spark, odd, nothing, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, small).count() <= odd.count()
        assert stage(spark, nothing, small).count() == 0

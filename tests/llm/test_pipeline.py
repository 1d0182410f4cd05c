"""The corpus pipeline against a brute-force version of its stages."""

import collections
import re

import numpy as np

import corpus_pipeline
from lexmill.llm.common import cut

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sentence(n, seed, letters):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def _shingles(t):
    w = WORD.findall(t.translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(docs, items):
    docs = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t) and "щ" not in t}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = collections.defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(held[key(x)]) < 5 or max(held[key(x)]) == i) for i, t in docs.items()}
    sets, low = {i: _shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    docs = {i: t for i, t in docs.items() if low[i] == i}
    return {i: t for i, t in docs.items() if not any(s and 4 * len(s & sets[i]) >= 3 * len(s) for s in map(_shingles, items))}


def test_pipeline_equals_brute_force(spark, tmp_path):
    line = "Every page of this site carries the very same long notice."
    texts = {i: _sentence(30 + 5 * i, i, "abcdefg" if i % 2 else "hijklmn") for i in range(40)}
    texts |= {40: texts[3], 41: texts[5].upper(), 42: None, 43: "", 44: "12 34", 45: "щъжф " * 60}
    texts |= {50 + i: f"{_sentence(40, 200 + i, 'abcdefg')}\n{line}" for i in range(6)}
    items = [_sentence(20, 300, "abcdefg"), _sentence(20, 301, "hijklmn")]
    texts |= {60: f"{_sentence(100, 400, 'abcdefg')} {items[0]} {_sentence(30, 401, 'abcdefg')}"}
    rows = [(i, t, None if i >= 40 else "xx" if i % 2 else "yy", f"s{i % 4}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, docs = _brute(texts, items), spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in docs.collect()} == want and 60 not in want and 45 not in want and 40 not in want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(want) and all(0 < r.taken <= 2 * r.size == 2 * len(WORD.findall(r.text)) for r in got)
    total = sum(len(WORD.findall(t)) for t in want.values())
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 20
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sum(len(WORD.findall(t)) for i, t in want.items() if f"s{i % 4}" == source)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and own[0].target <= 2 * own[0].source_size


def test_ngram_join_drops_rows_not_ids(spark):
    a, b, c, d = (_sentence(40, 500 + i, "abcdefg") for i in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, b), (3, a), (3, d), (4, None), (4, None), (4, ""), (None, None)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    got = [tuple(r) for r in corpus_pipeline.ngram_join(spark, docs, "").collect()]
    want = [(1, a), (2, b), (None, c), (3, d), (4, None), (4, ""), (None, None)]
    assert collections.Counter(got) == collections.Counter(want)

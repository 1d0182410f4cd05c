"""Small tests of every corpus operator: brute force, edge rows and clashing columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from lexmill.llm import decontaminate, hasharray, htmltext, langid, linededup, mixing, ngramjoin, packing, pitmanyor, quality, registry, restaurants, suffixdedup, tokens, warc
from lexmill.llm.common import cut, meet, release, spare

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, key string, fp long, component long, n_dropped long, kept string"
_rng = np.random.default_rng(5)
_VOCAB = ["".join(_rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]


def sentence(n, seed):
    return " ".join(np.random.default_rng(seed).choice(_VOCAB, n))


def edge_texts():
    base = sentence(80, 1)
    line = "This line stands in very many documents, word for word."
    texts = [None, "", " \n\t ", "one", "Two words", base, base, base.upper(), base.replace(" ", "\n", 3), " ".join(base.split()[:78] + ["x", "y"]), sentence(80, 2)]
    texts += [f"{line}\nown line number {i} {sentence(12, 100 + i)}\n  {line.upper()} " for i in range(7)]
    texts += [("long " + sentence(200, 3) + " é ") * 30, "ü" * 900, "#*$ %&| <>" * 30, sentence(25, 4) + "\n" + sentence(25, 4)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s%d" % (i % 3) if i % 7 else None, 1, 2, 3, "k", 4, 5, 6, "z") for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, sentence(60, 9), None, None, None, None, None, None, None, None, None, None)]
    return cut(spark.createDataFrame(rows, SCHEMA), "edge-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_quality_counts(docs, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(edge_texts()):
        w, t = words(t), t or ""
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_sources(empty).count() == 0
    total, by = sum(r["size"] for r in rows), collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v) and 0 <= v[0].target <= 2 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= 3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert "text" in mixing.take_mix(docs).columns


def test_line_dedup(docs, empty):
    out = linededup.dedup_lines(docs)
    assert linededup.dedup_lines(empty).count() == 0 and set(docs.columns) <= set(out.columns)
    keys = collections.defaultdict(set)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in enumerate(edge_texts()):
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 40:
                keys[strip(x)].add(i)
    for r in out.filter("doc_id is not null").collect():
        lines = (edge_texts()[r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(keys[strip(x)]) < 5 or max(keys[strip(x)]) == r.doc_id]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert out.filter("n_dropped > 0").count() == 6


def test_jaccard_components(spark, docs, empty):
    texts = edge_texts() + [sentence(60, 9)]
    sets = [shingles(t) for t in texts]
    low = list(range(len(sets)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    low[i] = min(low[i], low[j])
    for r in ngramjoin.jaccard_join(docs).filter("doc_id is not null").collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), low[r.doc_id])
    assert ngramjoin.jaccard_join(empty).count() == 0
    # a chain: neighbours link, ends do not; many near copies of one text
    base = sentence(300, 77).split()
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(0, i, 1):
            w[(k * 7) % 300] = f"edit{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    chain = [shingles(t) for _, t in rows]
    low = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 100 * len(chain[i] & chain[j]) >= 75 * len(chain[i] | chain[j]):
                    low[i] = min(low[i], low[j])
    assert got == dict(enumerate(low))


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
    index = ngramjoin.InvertedIndex(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.search(q)) == want


def test_decontamination(spark, docs, empty):
    words_ = sentence(40, 55).split()
    items = spark.createDataFrame([(1, " ".join(words_)), (2, sentence(40, 56)), (3, "one"), (4, None), (5, ""), (6, sentence(9, 1)), (1, " ".join(words_))], "item_id long, text string")
    near = list(words_)
    near[20] = "changed"
    more = spark.createDataFrame([(900, sentence(3000, 60) + " " + " ".join(words_).upper() + " " + sentence(500, 61)), (901, " ".join(near)), (902, " ".join(words_[:15]))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    all_docs = {**dict(enumerate(edge_texts())), 900: more.collect()[0].text, 901: more.collect()[1].text, 902: more.collect()[2].text}
    want = {(d, i) for d, t in all_docs.items() for i, x in {r.item_id: r.text for r in items.collect()}.items() if shingles(x) and 4 * len(shingles(x) & shingles(t)) >= 3 * len(shingles(x))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(both, items).collect()} == want
    assert {(900, 1), (901, 1), (3, 3)} <= want and (902, 1) not in want
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.decontaminate(both, items)
    assert {r.doc_id for r in kept.collect()} == (set(all_docs) | {None}) - {d for d, _ in want} and kept.columns == both.columns


def test_decontamination_of_repeated_ids(spark):
    """Texts of one id are items of their own, of whatever size."""
    items = [(i, sentence(14, 1000 + 2 * i + k)) for i in range(40) for k in (0, 1)] + [(i, "solo%d" % i) for i in range(3)]
    held = [(n, sentence(60, 5000 + n) + " " + t + " " + sentence(60, 7000 + n)) for n, (_, t) in enumerate(items)]
    got = decontaminate.find_leaks(spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    # an item of one word stands alone as a whole text only
    assert {(r.doc_id, r.item_id) for r in got} == {(n, i) for n, (i, t) in enumerate(items) if " " in t} and len(got) == 80
    mixed = spark.createDataFrame([(1, items[0][1]), (1, items[1][1]), (1, items[0][1])], "doc_id long, text string")
    pairs = decontaminate.find_leaks(mixed, spark.createDataFrame([(7, items[0][1]), (8, items[0][1] + " " + items[1][1])], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in pairs] == [(1, 7)]


def test_rare_languages_are_learned(spark):
    rows = [(i, sentence(30, 300 + i), "many") for i in range(60)] + [(100 + i, "zzyx qquw " * 20, f"rare{i}") for i in range(12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows}) and np.isfinite(model.limits).all()


def test_languages_that_are_all_rare_still_reject(spark):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "one": "opqrstu"}
    rng = np.random.default_rng(17)
    text = lambda lang: " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 7))) for _ in range(60))
    langs = ["aa"] * 15 + ["bb"] * 15 + ["one"]
    model = langid.train(spark.createDataFrame([(i, text(x), x) for i, x in enumerate(langs)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(letters) and np.isfinite(model.limits).all()
    out = model.predict([text("aa"), text("bb"), "щъжф " * 60, "", None])
    assert list(out["accepted"]) == [True, True, False, False, False] and list(out["lang_pred"])[:2] == ["aa", "bb"]


def test_suffix_dedup(spark, docs, empty):
    passage = sentence(120, 70)
    texts = [*edge_texts(), "a " + passage + " end", passage + passage, "b" * 1500, passage[:399], "x" + passage[:400] + "y"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, n_bytes int")
    count = collections.Counter()
    for t in texts + [texts[5]]:
        b = (t or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    out = suffixdedup.dedup_windows(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        b = (texts[r.doc_id] or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == (bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), runs), r.doc_id
    assert suffixdedup.dedup_windows(empty).count() == 0


def test_suffix_dedup_over_segments(spark, monkeypatch):
    text = np.random.default_rng(70).bytes(suffixdedup.SEGMENT // 2 + 60_000).hex()
    assert len(text) > suffixdedup.SEGMENT + suffixdedup.WINDOW
    df = spark.createDataFrame([(1, text), (2, text[-1000:-300])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffixdedup.dedup_windows(df).collect()} == {1: 700, 2: 700}
    for part in (text[:3000], "a" * 3000, text[:500] * 5):
        data = np.frombuffer(part.encode(), np.uint8)
        gram = [bytes(data[i : i + suffixdedup.GRAM]) for i in range(len(data) - suffixdedup.GRAM + 1)]
        rank = suffixdedup.gram_hashes(data) >> np.uint64(28)
        want = []
        for w in range(len(data) - suffixdedup.WINDOW + 1):
            at = w + int(rank[w : w + suffixdedup.REACH + 1].argmin())
            if want and want[-1][0] == at:
                want[-1][2] = w
            else:
                want.append([at, w, w])
        for size in (1, 150, 700, 1 << 22):
            monkeypatch.setattr(suffixdedup, "SEGMENT", size)
            at, first, last, core = (np.concatenate(x) for x in zip(*suffixdedup.anchor_runs(data)))
            assert np.stack([at, first, last], axis=1).tolist() == want
            assert len(core) == len(at) and len({(c, gram[a]) for c, a in zip(core.tolist(), at.tolist())}) == len(set(core.tolist()))


def test_language_id(spark, docs, empty):
    letters = {"aa": "abcdefg", "bb": "hijklmn"}
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rng = np.random.default_rng(i)
        rows.append((i, " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(40)), lang))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled.filter("doc_id < 50"))
    out = {r.doc_id: r for r in langid.identify(labelled, model).collect()}
    assert all(out[i].lang_pred == rows[i][2] and out[i].accepted and 0 <= out[i].score <= 1 for i in range(60))
    odd = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and not odd[0].accepted and odd[0].score == 0
    assert odd[4].lang_pred in letters and langid.identify(empty, model).count() == 0
    foreign = spark.createDataFrame([(1, "щъжфц " * 50)], "doc_id long, text string")
    assert not langid.identify(foreign, model).first().accepted
    assert langid.train(labelled.limit(0)) is None and {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_left_out_is_rejected(spark):
    def text(lang, i):
        rng = np.random.default_rng([lang, i])
        chains = np.random.default_rng(lang).dirichlet(np.full(12, 0.3), 12)
        at, out = 0, []
        for _ in range(400):
            at = rng.choice(12, p=chains[at])
            out.append("abcdefghijk "[at])
        return "".join(out)

    noise = lambda i: "".join(np.random.default_rng([9, i]).choice(list("abcdefghijk "), 400))
    rows = [(i, text(i % 2, i), "ab"[i % 2]) for i in range(1600)] + [(2000 + i, noise(i), "ab"[i % 2]) for i in range(10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(i, text(i % 3, 5000 + i)) for i in range(600)], "doc_id long, text string")
    got = collections.Counter((r.doc_id % 3, r.accepted) for r in langid.identify(new, model).collect())
    assert got[0, True] >= 195 and got[1, True] >= 195 and got[2, True] <= 2, got


def test_kneser_ney_sums_to_one():
    code, _, _ = langid.gram_codes(["abracadabra abra", "cad bra"])
    grams = {"xx": np.unique(code, return_counts=True)}
    counts = langid._orders(*grams["xx"])
    symbols = np.unique(counts[1].code)
    for ctx in np.unique(counts[4].ctx):
        p = langid._probability(counts, (ctx << np.uint64(16)) | symbols, 4, 1.0 / len(symbols))
        assert abs(p.sum() - 1) < 1e-9


def test_lm_score(spark, docs, empty):
    rows = docs.selectExpr("doc_id", "text", "coalesce(crc32(cast(doc_id as string)) % 7 = 2, false) as is_held_out")
    out = {r.doc_id: r for r in pitmanyor.score_texts(rows).collect() if r.doc_id is not None}
    texts = edge_texts()
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2] + [texts[5], sentence(60, 9)]
    count = collections.Counter(x for t in train for x in [*words((t or "").translate(LOW)), None])
    total, kinds = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w = [*words((t or "").translate(LOW)), None]
        base = sum(np.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-4 * abs(base) and np.isfinite(r.score) and r.score < 0
    none = pitmanyor.score_texts(rows, "false").collect()
    assert len(none) == docs.count() and all(np.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert pitmanyor.score_texts(empty.selectExpr("doc_id", "text", "true as is_held_out")).count() == 0


def test_lm_score_by_brute_force(spark):
    """Every word and pair of training occurs once, so all tables are known and only the spelling is sampled."""
    texts = {"t": ("Aa bb cc dd", False), "h": ("aa bb zz", True), "u": ("zz cc", True), "x": ("qqqqqqqq", True), "n": (None, True)}
    df = spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id string, text string, is_held_out boolean")
    got = {r.doc_id: r for r in pitmanyor.score_texts(df).collect()}
    train = ["aa", "bb", "cc", "dd", ""]
    rows = spark.createDataFrame([(w.encode(), 1) for w in train], "word binary, t int")
    spelling = pitmanyor.train_spelling(pitmanyor.spelling_grams(rows), pitmanyor.SAMPLES)
    p0 = lambda w: float(spelling.words([w.encode()])[0])
    s, d = pitmanyor.STRENGTH, 0.95
    p1 = lambda w: ((1 - d) * (w in train) + (s + d * 5) * p0(w)) / (s + 5)
    pairs = set(zip(["", *train[:-1]], train))

    def p(u, w):
        if u not in train:
            return p1(w)
        return ((1 - d) * ((u, w) in pairs) + (s + d) * p1(w)) / (s + 1)

    for k, (t, _) in texts.items():
        w = [*words((t or "").translate(LOW)), ""]
        want = sum(np.log10(p(a, b)) for a, b in zip(["", *w[:-1]], w))
        assert abs(got[k].score - want) < 1e-4 * abs(want), k
    for u in [*train, "zz"]:
        outside = (s + d * 5) * (1 - sum(map(p0, train))) / (s + 5) * ((s + d) / (s + 1) if u in train else 1)
        assert abs(sum(p(u, w) for w in train) + outside - 1) < 1e-6


def test_lm_score_contexts_and_spelling(spark, monkeypatch):
    rows = [(1, "alpha beta gamma delta", True), (2, "delta gamma beta alpha", True), (3, "alpha betta", True), (4, "alpha zqxjkvzq", True)]
    rows += [(10 + i, "alpha beta gamma delta" if i < 6 else "beta alpha zeta", False) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_held_out boolean")
    first = {r.doc_id: r for r in pitmanyor.score_texts(df).collect()}
    got = {k: r.score for k, r in first.items()}
    assert got[1] > got[2] + 1 and got[3] > got[4] + 1
    # Words and pairs outside the arrays are joined; with few tokens a shard, contexts are split over shards.
    for name, value in (("HEAD", 2), ("PAIRS", 1), ("SHARD", 6)):
        monkeypatch.setattr(pitmanyor, name, value)
    joined = {r.doc_id: r for r in pitmanyor.score_texts(df).collect()}
    for i, r in joined.items():  # seatings are sampled in another order
        assert (r.n_tokens, r.n_known) == (first[i].n_tokens, first[i].n_known) and abs(r.base_score - first[i].base_score) < 1e-4 and abs(r.score - got[i]) < 0.2 * abs(got[i])


def test_lm_score_sends_no_row_a_text_and_shard(spark, monkeypatch):
    """A shard packs its sums by blocks of rows, so what it sends doesn't grow as texts times shards."""
    rows = [(i, sentence(40, i), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_held_out boolean").coalesce(1)
    sent, plain = {}, pitmanyor.cut
    monkeypatch.setattr(pitmanyor, "cut", lambda d, name: sent.setdefault(name, plain(d, name)) if name == "lm-found" else plain(d, name))
    for name, value in (("PAIRS", 1), ("SHARD", 100)):
        monkeypatch.setattr(pitmanyor, name, value)
    first = {r.doc_id: r.score for r in pitmanyor.score_texts(df).collect()}
    found = sent.pop("lm-found")
    packed = found.filter("blob is not null")
    assert found.filter("score is not null").count() <= 2 * len(rows) and 1 < packed.count() <= 41 and packed.select("block").distinct().count() == 1
    monkeypatch.setattr(pitmanyor, "BLOCK_BITS", 2)
    second = {r.doc_id: r.score for r in pitmanyor.score_texts(df).collect()}
    assert sent["lm-found"].filter("blob is not null").select("block").distinct().count() == 15
    assert len(first) == 60 and all(abs(first[i] - second[i]) < 1e-6 * abs(first[i]) for i in first)


def test_orders_and_hashes_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    close = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 5, 300).astype(np.uint64)  # alike in all leading bits
    for x in (np.zeros(0, np.uint64), np.array([7], np.uint64), close, rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)):
        kinds, first, inverse = hasharray.distinct(x)
        assert (x[hasharray.order_of(x)] == np.sort(x)).all()
        assert (kinds == np.unique(x)).all() and (x[first] == kinds).all() and (kinds[inverse] == x).all()
    monkeypatch.setattr(tokens, "BLOCK", 16)
    texts = ["", " \t", "a", "AbC  dé\x0bf\x1c g", "w" * 50 + " x " + "y" * 17, " lead", "trail\n"]
    for text in [*texts, " ".join(texts)]:
        raw = np.frombuffer(text.encode().lower(), np.uint8)
        h, first, length = tokens.hash_words(raw)
        want = words(text.translate(LOW))
        assert [bytes(raw[a : a + n]).decode() for a, n in zip(first, length)] == want
        assert h.tolist() == [int(tokens.hash_runs(np.frombuffer(w.encode(), np.uint8), np.array([len(w.encode())]))[0]) for w in want]


def test_few_dishes_are_seated_alike(monkeypatch):
    """Seating dish by dish gives the same distribution of tables as seating all at once."""
    mean = {}
    for few in (0, 1 << 30):
        monkeypatch.setattr(restaurants, "FEW", few)
        opened, ranks = restaurants.propose(np.full(4000, 30.0), np.full(4000, 0.4), np.full(4000, 0.2), 0.6, np.random.default_rng(3))
        assert len(ranks) == opened.sum() and (ranks < 30).all() and (ranks >= 1).all()
        mean[few] = opened.mean()
    assert abs(mean[0] - mean[1 << 30]) < 0.15


def test_spelling_sums_to_one():
    rng = np.random.default_rng(1)
    raw = rng.choice(np.frombuffer(b"abc", np.uint8), 400)
    first = np.arange(0, 400, 8)
    code, _ = pitmanyor.gram_codes(raw, first, np.full(50, 8))
    keys, n = np.unique(code, return_counts=True)
    root = np.full(256, 1 / 256)
    model = pitmanyor.Spelling(root, pitmanyor.sample_restaurants(keys, n, root, 1))
    p = np.exp(model.log().astype(float)).reshape(-1, 256).sum(axis=1)
    assert abs(p - 1).max() < 1e-3


def test_reseating_leaves_the_posterior():
    """Tables of many independent dishes after some moves against the exact distribution from the recurrence of seatings."""
    c, d, new, more = 10, 0.6, 0.05, 0.3
    ways = np.zeros((c + 1, c + 2))
    ways[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 1):
            ways[n + 1, t] += ways[n, t] * (n - d * t)
            ways[n + 1, t + 1] += ways[n, t]
    want = np.array([ways[c, t] * np.prod([new + more * j for j in range(1, t)]) for t in range(1, c + 1)])
    want /= want.sum()
    m, rng = 20000, np.random.default_rng(1)
    seats = np.zeros(m, dtype=np.int64), np.zeros(0)
    for _ in range(40):
        seats = restaurants.reseat(np.full(m, c), np.full(m, new), np.full(m, more), d, *seats, rng)
        assert len(seats[1]) == seats[0].sum() and (seats[1] < c).all() and (seats[1] >= 1).all()
    got = np.bincount(seats[0] + 1, minlength=c + 1)[1:] / m
    assert abs(got - want).max() < 0.015
    opened, ranks = restaurants.carry(np.array([3, 9]), np.array([2, 1]), np.array([1.0, 5.0, 4.0]))
    assert opened.tolist() == [1, 1] and ranks.tolist() == [1.0, 4.0]


def test_packing():
    values = np.array([0, 5, 5, 2**63 + 9], dtype=np.uint64)
    back = packing.unsqueeze(packing.squeeze(packing.steps(values), np.arange(0), np.array([7, 300])))
    assert packing.unstep(back[0]).tolist() == values.tolist() and len(back[1]) == 0 and back[2].tolist() == [7, 300]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\n", None), (2, None, ""), (3, "http://b/", "é" * 50000), (3, "http://b/", "é" * 50000), (None, "x", "é" * 50000), (4, "x", "WARC/1.1\r\n\r\n0\r\n\r\n" * 3000), (5, "y", "<p>")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    got = back.collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = by[page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        if r.record_type == "response":
            assert bytes(r.payload) == payload
    assert [(k, by[k][0].record_type, by[k][0].refers_to) for k in (1, 2, 3, None)] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (None, "revisit", 3)]
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_text_ids(spark, tmp_path):
    rows = [("b%\r\n é", "u", "same"), ("a", "u", "same"), (None, "u", "same"), ("", "u", "other"), ("10", "u", "more"), ("9", "u", "more")]
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to, r.complete) for r in warc.read_archives(spark, str(tmp_path / "w"), "string").collect()}
    assert got == {"b%\r\n é": ("response", None, True), "a": ("revisit", "b%\r\n é", True), None: ("revisit", "b%\r\n é", True), "": ("response", None, True), "9": ("response", None, True), "10": ("revisit", "9", True)}


def test_warc_incomplete_segments(spark):
    schema = warc._HEADERS + ", block binary"
    rows = [("a", "response", "a", 1, None, 1, "u", None, None, bytearray(b"12")), ("b", "continuation", "a", 3, 4, None, "u", None, None, bytearray(b"34")), ("c", "response", "c", 1, None, 2, "u", None, None, bytearray(b"12")), ("d", "continuation", "c", 2, 4, None, "u", None, None, bytearray(b"34"))]
    got = {r.page_id: (r.complete, bytes(r.block)) for r in warc.reassemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (False, b"1234"), 2: (True, b"1234")}
    assert warc.dechunk(warc.chunked(b"x" * 10000)) == b"x" * 10000 and warc.dechunk(b"5\r\nab") is None


def test_html_text(spark):
    page = lambda title, body: f"<html><head><title>{title}</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"
    rows = [(i, "http://h.example/%d" % i, page(f"t{i}", f"<div><p>Follow our    weekly letter</p></div><h1>Head {i}</h1><p>Own &amp; text {i}<p>more<br>here {i}")) for i in range(20)]
    art = page("a", "<header>top</header><nav>x</nav><div class='cookie-notice'>c</div><article><header><h1>T</h1></header><p>A&nbsp;&lt;b&gt;</p><ul><li>1<li>2</ul><div id='comments'><p>c</p></div><form>f</form></article><aside>s</aside><footer>f</footer>")
    rows += [(100, "http://g.example/", art), (101, None, None), (102, "http://g.example/", ""), (103, "bad", "just text <b>bold</b> &eacute;")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract_text(df).collect()}
    assert got[3].text == "Head 3\nOwn & text 3\nmore here 3"
    assert got[100].text == "T\nA <b>\n1\n2" and got[101].text == got[102].text == "" and got[103].text == "just text bold é"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_html_template_by_pages(spark):
    page = lambda body: f"<html><head><title>One title</title></head><body>{body}</body></html>"
    rows = [(i, "http://one.example/%d" % i, page(f"<div>Our letter</div><p>Own {i}</p>")) for i in range(12)]
    rows += [(100 + i, "http://copies.example/%d" % i, page("<p>Same text</p>")) for i in range(12)]
    part = lambda i: "<div>Section</div>" if i < 150 else "<div>Small</div>" if i < 270 else ""
    rows += [(1000 + i, "http://hot.example/%d" % i, page(f"{part(i)}<p>Own {i}</p>")) for i in range(700)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own 3" and got[105] == "Same text"
    assert got[1005] == "Own 5" and got[1160] == "Small\nOwn 160"  # a share of the host's pages, whatever its size


def test_html_main_part():
    long = "This is what the page is about, and there is a lot of it. " * 8
    p = f"<p>{long}</p>"
    told = " ".join(long.split())
    comments = "<ol class='comment-list'>" + "<li><article><p>I am a reader and I disagree.</p></article></li>" * 9 + "</ol>"
    assert htmltext.main_text(p + comments) == told
    assert htmltext.main_text(f"<article>{p}</article><div id='comments'>{'<article>reader words</article>' * 50}</div>") == told
    card = "<div><article><h3>Read next</h3><p>Another story.</p></article></div>"
    assert told in htmltext.main_text(f"<div>{p * 3}</div>" + card)
    for name in ("has-overlay hero", "menu-item-description", "sidebar-layout"):
        assert htmltext.main_text(f"<div class='{name}'><article>{p}</article></div><p>c</p>") == told
        assert htmltext.main_text(f"<div class='{name}'>{p}</div>") == told
    assert htmltext.main_text(f"<main>{p}</main><div class='menu'>{'<a href=x>Some entry of a menu</a>' * 200}</div>") == told
    assert htmltext.main_text(f"<article>{p}<p class='ads'>Buy it</p><p>a <span class='advert'>now</span> b</p></article>") == told + "\na b"
    assert htmltext.main_text(f"<main>{p}{card}</main>") == told + "\nRead next\nAnother story."
    assert htmltext.main_text("<div class='menu'><a>x</a></div>") == "" and htmltext.main_text("<div class='comments'>only readers</div>") == ""


def test_html_shared_parts_of_articles(spark):
    """What articles of a host share stays, but for large containers; the same outside of them is template."""
    box = "<div>" + "<p>About this dictionary, its makers and its readers.</p>" * 6 + "</div>"
    entry = lambda i: f"<h2>Etymology</h2><p>Word {i}</p><table><tr><td>Countable</td><td>Yes</td></tr></table><ul><li>noun</li></ul>"
    rows = [(i, f"http://in.example/{i}", f"<article>{entry(i)}{box}</article><p>Imprint</p>") for i in range(30)]
    rows += [(100 + i, f"http://out.example/{i}", f"<h2>Etymology</h2><p>Word {i}</p>") for i in range(30)]
    got = {r.page_id: r.text for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Etymology\nWord 4\nCountable\nYes\nnoun" and got[104] == "Word 4"


def test_html_extraction_by_brute_force():
    """Random well-formed pages against a plain recursion over a standard parser's tree."""
    import xml.etree.ElementTree as ET

    rng = np.random.default_rng(8)

    def make(depth):
        tag = str(rng.choice(["div", "p", "b", "ul", "section", "span", "nav", "aside", "h2", "pre"] if depth else ["div"]))
        inner = "".join(str(rng.choice(["x y ", " z", "&amp;", "w\n"])) if rng.random() < 0.5 or depth > 4 or tag in ("p", "h2") else make(depth + 1) for _ in range(int(rng.integers(0, 5))))
        name = str(rng.choice(["", "", "", " class='menu'", " class='ads'", " class='text'", " id='comments'"]))
        return f"<{tag}{name}>{inner}</{tag}>"

    def read(node, out):
        if node.tag in ("nav", "aside") or node.get("class") == "ads" or (node.tag in ("div", "section", "ul") and (node.get("class") == "menu" or node.get("id") == "comments")):
            return
        block = node.tag not in ("b", "span")
        if block:
            out.append("")
        out[-1] += node.text or ""
        for child in node:
            read(child, out)
            out[-1] += child.tail or ""
        if block:
            out.append("")

    for _ in range(300):
        body = "<p>" + "enough words to be the page " * 60 + "</p>" + "".join(make(0) for _ in range(4))
        out = [""]
        read(ET.fromstring(f"<root>{body}</root>"), out)
        want = "\n".join(x for x in (" ".join(b.split()) for b in out) if x)
        assert htmltext.main_text(body) == want, body


def test_html_depth_and_unclosed_tags():
    assert htmltext.main_text("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
    assert htmltext.main_text("<p>x</p>" + "<a " * 350_000) == "x"
    assert htmltext.main_text('<p>x</p><a href="' * 50_000).startswith("x\nx")  # every second quote closes one
    page = '<article><p class="print">kept?</p><p><math><mi>x</mi></math> <label>lab</label></p><div class="comments">no</div><form>no</form>1 &lt; 2 < 3</article>'
    assert htmltext.main_text(page) == "kept?\nx lab\n1 < 2 < 3"


def test_html_templates_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{i % 3}", int(rng.integers(0, 40)), bool(rng.integers(0, 12) == 0), int(rng.integers(0, 30))) for i in range(900)]
    got = {(r.host, r.h) for r in htmltext.templates(spark.createDataFrame(rows, "host string, h long, doubtful boolean, kept long"), 4, 0.3).collect()}
    pages, doubt, size = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for host, h, doubtful, kept in rows:
        pages[host, h].add(kept)
        doubt[host, h] += doubtful
        size[host].add(kept)
    want = {k for k, v in pages.items() if (doubt[k] and len(v) >= 2) or (len(v) >= 4 and len(v) >= 0.3 * len(size[k[0]]))}
    assert got == want and 0 < len(want) < len(pages)


def test_pieces_keep_their_context(monkeypatch):
    grams = {"xx": np.unique(langid.gram_codes(["abracadabra abba cad"])[0], return_counts=True), "yy": np.unique(langid.gram_codes(["bold cold"])[0], return_counts=True)}
    model = langid.LanguageModel(["xx", "yy"], grams)
    texts = ["abra  cold, 12 " * 9, "a" + " " * 50 + "b", "", None, "abracadabra"]
    want = model.entropies(texts)
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(langid, "PIECE", size)
        assert all(np.allclose(a, b) for a, b in zip(want, model.entropies(texts)))


def test_entropies_by_brute_force():
    texts = {"aa": "abracadabra abba cad", "bb": "bold cold old gold"}
    grams = {k: np.unique(langid.gram_codes([t])[0], return_counts=True) for k, t in texts.items()}
    model = langid.LanguageModel(["aa", "bb"], grams)
    symbols = set("".join(texts.values()))
    for text in ("abra cold", "zz?", "gold"):
        chars = re.sub(r"[^a-z]+", " ", text.lower())
        h, events, letters = model.entropies([text])
        for k, lang in enumerate(model.langs):
            train = texts[lang]
            counts = {4: collections.Counter(("   " + train)[i : i + 4] for i in range(len(train)))}
            for n in (3, 2, 1):
                counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
            d = {n: (o := max(sum(v == 1 for v in c.values()), 1)) / (o + 2 * sum(v == 2 for v in c.values())) for n, c in counts.items()}

            def p(g, n):
                if n == 0:
                    return 1 / (len(symbols) + 1)
                own = {x: v for x, v in counts[n].items() if x[:-1] == g[-n:-1]}
                lower = p(g, n - 1)
                return (max(own.get(g[-n:], 0) - d[n], 0) + d[n] * len(own) * lower) / sum(own.values()) if own else lower

            want = -np.mean([np.log(p(("   " + chars)[i : i + 4], 4)) for i in range(len(chars))])
            assert abs(h[0, k] - want) < 1e-4 and events[0] == len(chars) and letters[0] == sum(c.isalpha() for c in chars)


def test_candidates_are_complete(spark):
    base = sentence(64, 91).split()
    items = [(i, " ".join(base[i : i + 9 + i % 7])) for i in range(30)]
    docs_ = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for cut_ in range(len(w)):
            docs_.append((100 * i + cut_, " ".join([*w[:cut_], "other", *w[cut_ + 1 :], "tail"])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs_ for i, x in items if 4 * len(shingles(x) & shingles(t)) >= 3 * len(shingles(x))}


CLASHES = ["_id", "_answer", "score", "accepted", "lang_pred", "_key", "_keys", "_new", "_tid", "_spans", "_rid", "_cuts", "_plan", "_ld_keys", "_text", "src", "copies", "prefix", "budget", "key", "cluster", "salt", "segment", "part", "rid", "h", "kept"]


def test_string_ids_and_clashing_columns(spark):
    texts = edge_texts()
    plain = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    named = plain.selectExpr("concat('d', lpad(doc_id, 4, '0')) as doc_id", "text", "source", *[f"'{c}' as {c}" for c in CLASHES])
    to_id = lambda d: f"d{d:04d}" if isinstance(d, int) else d
    runs = {
        "lines": (lambda d: linededup.dedup_lines(d), ["text", "n_lines", "n_dropped"]),
        "windows": (lambda d: suffixdedup.dedup_windows(d), ["n_bytes", "n_removed", "n_spans"]),
        "jaccard": (lambda d: ngramjoin.jaccard_join(d), ["n_shingles", "component_id"]),
    }
    for name, (run, columns) in runs.items():
        a = sorted((to_id(r.doc_id), *[to_id(r[c]) if c == "component_id" else r[c] for c in columns]) for r in run(plain).collect())
        out = run(named)
        b = sorted((r.doc_id, *[r[c] for c in columns]) for r in out.collect())
        assert a == b, name
        if name != "jaccard":
            assert set(CLASHES) <= set(out.columns) and {r["_key"] for r in out.collect()} == {"_key"}
    mixed = mixing.take_mix(named)
    assert set(CLASHES) <= set(mixed.columns) and mixed.filter("_key <> '_key' or src <> 'src'").count() == 0 and mixed.count() > 0
    known = langid.filter_languages(named, plain.selectExpr("doc_id", "text", "'en' as lang"))
    assert known.columns == named.columns and known.count() > 0 and known.filter("score <> 'score' or _answer <> '_answer' or accepted <> 'accepted'").count() == 0
    pages = named.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    out = htmltext.extract_text(pages)
    assert out.count() == len(texts) and set(CLASHES) <= set(out.columns)


def test_line_filters_at_any_size(spark, docs):
    want = sorted(map(str, linededup.dedup_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    full = sorted(map(str, linededup.dedup_lines(docs, bits=1 << 20).select("doc_id", "text", "n_dropped").collect()))
    assert want == full and linededup.filter_bits(0, 40) == 1 << 20 and linededup.filter_bits(10**15, 40) == 1 << 30
    lines = [(i, f"line {i % 400} of a text that is long enough to count as one line here") for i in range(1000)]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    twice = linededup.twice_seen(df.select("text").repartition(7), 40, 1 << 20)
    seen = collections.Counter(linededup.line_keys(t, 40)[0] for _, t in lines)
    hit = {k: all(twice[int(b) >> 3] >> (int(b) & 7) & 1 for b in linededup._probes([k], 1 << 20)[0]) for k in seen}
    assert all(hit[k] for k, n in seen.items() if n > 1) and sum(hit[k] for k, n in seen.items() if n == 1) <= 2


def test_helpers(spark):
    rows = cut(spark.createDataFrame([(i % 3 if i < 3000 else i, i) for i in range(3100)], "k long, v long"), "helper")
    keyed = rows.groupBy("k").count().filter("k % 2 = 0")
    for how in ("inner", "left_semi", "left_anti"):
        want = sorted(r.v for r in rows.join(keyed.drop("count"), "k", how).collect())
        assert sorted(r.v for r in meet(rows, keyed, ["k"], "count", how).collect()) == want
    assert spare(rows, "k") == "_k" and spare(rows.withColumn("_K", rows.k), "k") == "_k_"
    release(rows)


def test_registry_has_all():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and set(registry.oracle_sql()) <= set(names)

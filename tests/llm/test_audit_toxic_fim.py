"""Source divergence, toxicity and fill-in-the-middle: brute force, edge rows, repeated rows and long texts."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from lexmill.llm import divergence, fillmiddle, toxicity
from lexmill.llm.common import cut

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, score double, form string, n long"
_rng = np.random.default_rng(11)
_VOCAB = ["".join(_rng.choice(list("abcdeé日"), 3)) for _ in range(60)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(_VOCAB, n))


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n ", "one", "ONE one É é", "a1b2c3", "mark <P> inside", "x" * 50, "日本語 " * 9, prose(40, 1), prose(40, 1)]
    return out + [prose(30 + i, 50 + i) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "", "a", "b", "c"][i % 5], "t", 0.5, "f", 3) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, prose(20, 3), "en", "only", None, None, None, None), (99, None, "xx", "lone", None, None, None, None)]
    return cut(spark.createDataFrame(rows, SCHEMA), "audit-docs")


def brute_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, docs_of, total = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        ts = term.findall((text or "").translate(LOW))
        groups[lang or "", source or ""].update(ts)
        total[lang or ""].update(ts)
        docs_of.update((lang or "", t) for t in set(ts))
    out = []
    for lang in total:
        kept = [t for t in total[lang] if docs_of[lang, t] >= min_docs]

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        q, own = p(total[lang]), {s: p(c) for (x, s), c in groups.items() if x == lang}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(own[s][t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and own[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 7, 200])
def test_audit_equals_brute_force(docs, top):
    got = sorted(map(tuple, divergence.audit_sources(docs, top=top).collect()))
    assert got == brute_audit([(r.lang, r.source, r.text) for r in docs.collect()], 3, top)


def test_audit_of_little(docs):
    assert divergence.audit_sources(docs.limit(0)).count() == 0
    alone = divergence.audit_sources(docs.filter("doc_id < 2")).collect()
    assert all(r.value == 0 and r.part == "pair" for r in alone)


def test_term_counts_in_parts(spark, monkeypatch):
    """Long texts are counted in parts that cut no term, and count as one document."""
    text = (prose(400, 8) + " ") * 3
    tally = divergence._Tally.merged([divergence._Tally.of([p], [0], [0]) for p in (b"ab cd ab", b" ab ef")], one_document=True)
    assert sorted(zip(tally.length.tolist(), tally.count.tolist(), tally.docs.tolist())) == [(2, 1, 1), (2, 1, 1), (2, 3, 1)]
    monkeypatch.setattr(divergence, "CHUNK", 100)
    monkeypatch.setattr(divergence, "FLUSH", 50)
    assert b"".join(divergence._cut(text.encode())) == text.encode() and len(list(divergence._cut(text.encode()))) > 20
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 3), pa.array(["s", "s", "t"]), pa.array([text, "É é one " * 5, text.upper()])], names=["lang", "source", "text"])
    got = collections.defaultdict(lambda: [0, 0])
    for out in divergence._count_terms(iter([batch])):
        for r in out.to_pylist():
            got[r["source"], r["term"]][0] += r["count"]
            got[r["source"], r["term"]][1] += r["docs"]
    want = {("s", t): [n, 1] for t, n in collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)).items()}
    want |= {("s", "É"): [5, 1], ("s", "é"): [5 + want.get(("s", "é"), [0])[0], 1 + (("s", "é") in want)], ("s", "one"): [5, 1]}
    assert {k: v for k, v in got.items() if k[0] == "s"} == want


def fim(doc_id, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (doc_id, n, "plain", None, None), text
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if d % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return (doc_id, n, "spm" if d % 100 < 20 else "psm", a, b - a), out


@pytest.mark.parametrize("unit", [1, 7, 1 << 16])
def test_fill_in_middle(docs, unit):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [fim(r.doc_id, r.text) + (r.text or "",) for r in docs.collect()]
    got = fillmiddle.fill_in_middle(docs, unit=unit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*head, sha(out), sha(text))) for head, out, text in want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    whole = fillmiddle.fim_texts(docs, unit=unit).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted(map(str, map(tuple, whole))) == sorted(str((*head, out)) for head, out, _ in want)
    assert fillmiddle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_ids_and_repeats(spark):
    rows = [("k", "same text of an id"), ("k", "another text of it"), ("k", "same text of an id"), (None, "no id"), ("", "")] * 3
    got = fillmiddle.fill_in_middle(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert collections.Counter(r.doc_id for r in got) == {"k": 9, None: 3, "": 3}
    assert sorted(r.restored_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_restorer_reads_any_pieces(size):
    text = "<<P <S <M>> <"
    for form in ("psm", "spm"):
        out = "".join(fillmiddle.split_text(text, form, 3, 5))
        back, restorer = {}, fillmiddle.Restorer(form)
        for k in range(0, len(out), size):
            back |= {(p, o): t for p, o, t in restorer.feed(out[k : k + size])}
        back |= {(p, o): t for p, o, t in restorer.feed("", last=True)}
        assert "".join(back[k] for k in sorted(back)) == text


BAD = ["grotk", "snorvle", "blegh"]


def labelled(n, seed):
    """Documents of many sentences; toxic ones hold one or two bad words, often with an ending."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        sentences = [prose(int(rng.integers(4, 12)), int(rng.integers(1 << 30))) for _ in range(int(rng.integers(1, 15)))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * int(rng.integers(1, 3))):
            k = int(rng.integers(len(sentences)))
            sentences[k] += " " + BAD[int(rng.integers(3))] + ["", "a", "ing"][int(rng.integers(3))]
        yield i, ". ".join(sentences) + ".", toxic


@pytest.fixture(scope="module")
def model(spark):
    rows = list(labelled(800, 5))
    docs = cut(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), "toxic-docs")
    labels = cut(spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(1, None), (5000, 1)], "doc_id long, toxic int"), "toxic-labels")
    return toxicity.train(docs.filter("doc_id % 4 <> 1"), labels), docs, {i: (t, y) for i, t, y in rows}


def test_toxicity_held_out_and_located(model):
    fitted, docs, rows = model
    out = toxicity.score_toxicity(docs.withColumn("score", docs.doc_id), fitted).filter("doc_id % 4 = 1").collect()
    right = [r.predicted == rows[r.doc_id][1] for r in out]
    assert len(out) == 200 and np.mean(right) >= 0.97
    found = [(rows[r.doc_id][0][s.begin : s.begin + s.n_chars], r.doc_id) for r in out for s in r.offending]
    assert len(found) >= 40 and np.mean([any(b in x for b in BAD) for x, _ in found]) >= 0.95
    hit = sum(any(b in rows[r.doc_id][0][s.begin : s.begin + s.n_chars] for s in r.offending for b in BAD) for r in out if rows[r.doc_id][1])
    assert hit >= 0.95 * sum(rows[r.doc_id][1] for r in out)


def brute_score(model, text):
    """The noisy-or of sentences from their letters, one sentence after the other."""
    none = 1 - model.leak
    code = {int(c): w for c, w in zip(model.signs, model.weights)}
    for sentence in re.split(rb"(?<=[.!?\n])", text.encode()):
        folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", sentence.lower())
        folded = folded if folded.startswith(b" ") else folded
        own = {int.from_bytes(folded[i : i + n], "big") for n in toxicity.GRAMS for i in range(len(folded) - n + 1)} & set(code)
        if own:
            none *= 1 - min(1 / (1 + np.exp(-(model.bias + sum(code[c] for c in own)))), 1 - 1e-12)
    return 1 - none


def test_toxicity_equals_brute_force(model):
    fitted, _, rows = model
    texts = [t for t, _ in rows.values()][:60] + ["", None, "...", "É grotk! grotk", "日本語。 snorvle\nblegh"]
    got, _ = fitted.score(texts)
    # a text's first sentence opens with a space, as its others do after their end
    want = [brute_score(fitted, " " + (t or "")) for t in texts]
    assert np.allclose(got, want, atol=1e-9) and got[60] == got[61] == pytest.approx(fitted.leak)


def test_toxicity_pieces(model, monkeypatch):
    fitted, _, rows = model
    text = " ".join(t for t, _ in list(rows.values())[:80]) + "\n日本 grotk. é blegh grotk snorvle"
    want, (_, begin, length, own) = fitted.score([text, None, text])
    for piece in (300, 1000, 1 << 14):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        got, (_, begin_, length_, own_) = fitted.score([text, None, text])
        assert np.allclose(got, want) and begin_.tolist() == begin.tolist() and length_.tolist() == length.tolist() and np.allclose(own_, own)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    fitted.score(["日" * 500, "a" * 500])  # neither sentence ends nor white space


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    out = toxicity.score_toxicity(docs, None)
    assert {(r.score, r.predicted, len(r.offending)) for r in out.collect()} == {(0.0, 0, 0)} and out.count() == docs.count() and "lang" in out.columns
    one = spark.createDataFrame([(9, 1), (9, 0), (10, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, one) is None
    fitted = toxicity.Model(np.array([1], dtype=np.uint64), np.zeros(1), 0.0, 0.01)
    assert toxicity.score_toxicity(docs.limit(0), fitted).count() == 0
    assert toxicity.score_toxicity(docs, fitted).count() == docs.count()
    assert isinstance(toxicity.fit_bags([np.array([0]), np.array([], dtype=int)], [np.array([0]), np.array([], dtype=int)], np.array([True, False]), 1)[0], np.ndarray)
    assert pd.Series(fitted.score([None])[0]).tolist() == [pytest.approx(0.01)]

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from levelling.llm import pii
from levelling.llm.tokens import Words, blocks, lower_words, text_bytes, word_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aA bé\n\t9-|  ", max_size=12)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    texts = ["skip me", *texts]
    col = pa.array(texts, pa.string()).slice(1)
    assert word_counts(col).tolist() == [len(WORD.findall(t or "")) for t in texts[1:]]
    seen = {}
    for lo, hi, data, off in blocks(col, limit=10):
        w = Words(data, off)
        h = w.hashes()
        for i in range(hi - lo):
            words = lower_words(texts[1 + lo + i])
            assert w.off[i + 1] - w.off[i] == len(words)
            for word, x in zip(words, h[w.off[i]:w.off[i + 1]].tolist()):
                assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shapes_ignore_letters_and_lengths():
    data, off = text_bytes(pa.array(["Hello World +49 +4930 a-b éàü HELLO"]))
    s = Words(data, off).shapes().tolist()
    assert s[0] == s[1] and s[2] == s[3] and len({s[0], s[2], s[4], s[5], s[6]}) == 5


def plain(text):
    """Base spans by the patterns as they are written in the contract."""
    out = [("email", m.start(), m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0125@.+- ()é_", max_size=40))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_long_runs_are_quick():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "@" * 300_000):
        pii.base_spans(text)


def test_cards_and_addresses():
    text = "x 4111 1111-1111 1111, 4111111111111112 y 256.1.1.1 10.0.0.255.7 0010.1.1.1"
    assert pii.base_spans(text) == plain(text)
    assert [k for k, _, _ in pii.base_spans(text)] == ["ip", "ip", "card"]


def test_field_adds_numbers_without_country_code_and_leaves_clean_text(spark):
    model = pii.train(pii.labelled(spark))
    rows = [(1, "Ruf an: é (030) 555-7713 heute\nor 555-867-5309."), (2, None), (3, ""),
            (4, "Licensed under the Apache License, Version 2.0. In 1999-2004 it cost 12,500 or 4.0 | a | b!!"),
            (5, "mail a.34@mail7.example.com, call +1 (017) 555-7713"), (5, "(030) 555-7713 " * 3000),
            (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and*** the%%% of&&&')]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    got = [(r.doc_id, r.text, r.pii) for r in pii.find(docs, model).collect()]
    assert [g[:2] for g in got] == rows
    found = [[(x.kind, t[x.start:x.end], x.base) for x in p] for _, t, p in got if t]
    assert found[0] == [("phone", "(030) 555-7713", False), ("phone", "555-867-5309", False)]
    assert found[1] == [] and found[4] == [] and got[1][2] == [] and got[2][2] == []
    assert found[2] == [("email", "a.34@mail7.example.com", True), ("phone", "+1 (017) 555-7713", True)]
    assert len(found[3]) == 3000
    clean = [r.text for r in pii.redact(docs, model).collect()]
    assert clean[0] == "Ruf an: é [PHONE] heute\nor [PHONE]." and clean[1] is None and clean[3] == rows[3][1]
    assert clean[4] == "mail [EMAIL], call [PHONE]"
    assert pii.find(docs.limit(0), model).collect() == []


def test_viterbi_equals_exhaustive_search():
    from itertools import product

    from levelling.llm.crf import Crf
    rng = np.random.default_rng(0)
    m = Crf(["O", "a", "b"])
    m.emit[:] = rng.normal(size=m.emit.shape)
    m.trans[:], m.start[:] = rng.normal(size=m.trans.shape), rng.normal(size=3)
    feats = rng.integers(0, 20, (9, 4)).astype(np.int32)
    first = np.array([0, 4, 5])
    got = m.decode(feats, first)
    e = m.emissions(feats)
    for lo, hi in ((0, 4), (4, 5), (5, 9)):
        best = max(product(range(3), repeat=hi - lo), key=lambda p: m.start[p[0]] + sum(
            e[lo + i, x] for i, x in enumerate(p)) + sum(m.trans[x, y] for x, y in zip(p, p[1:])))
        assert tuple(got[lo:hi]) == best


def test_word_index_finds_its_words_only():
    from levelling.llm.tokens import WordIndex
    words = [b"", *(b"w%d" % i for i in range(5000))]
    index = WordIndex(words)
    data, off = text_bytes(pa.array(["w0 W17 w4999", None, "w5000 x", "w3"]))
    w = Words(data, off)
    assert index.of(w.hashes()).tolist() == [1, 18, 5000, -1, -1, 4]
    assert w.spelled(np.array([1, 3])) == [b"w17", b"w5000"]
    assert WordIndex([b""]).of(w.hashes()).tolist() == [-1] * 6

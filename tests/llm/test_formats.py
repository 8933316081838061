import base64
import hashlib
import itertools
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from levelling.llm import language_model, prefix_tree, queries, warc
from levelling.llm.gru import Gru, stretches
from levelling.llm.queries import TOKENIZER
from levelling.llm.tokens import lower_words
from tests.conftest import SF

# --- WARC ------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("aé<>\r\n0 ") for _ in range(9000))
    rows = [(1, "http://a/x y\r\nEvil: 1", big), (2, None, None), (3, "http://b", ""), (4, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"),
            (5, "u", big), (9, "u", big), (7, "u", "x" * 200), (6, "u", "x" * 200), (None, "u", "x" * 200),
            (8, "u", "solo"), (8, "u", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = warc.write_archives(pages, segment_bytes=500)
    got = warc.read_archives(spark, path, payload=True).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        kind = "response" if first[h or ""] == i else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind,
                     None if kind == "response" else first[h or ""]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                  key=str) == sorted(want, key=str)
    assert all(r.verified for r in got)
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
               for r in got if r.record_type == "response")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect())
    kinds = [h["warc-type"] for h, _ in warc.parse(raw)]
    assert kinds.count("continuation") >= 20 and kinds.count("response") + kinds.count("revisit") == len(rows)


def test_larger_payloads_only_are_revisited_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in
           warc.read_archives(spark, warc.write_archives(pages, min_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).collect() == []


def archive(spark, records, tmp):
    spark.createDataFrame([(b"".join(records)[:-4].decode(),)], "value string").write.option(
        "lineSep", "\r\n\r\n").text(tmp)
    return warc.read_archives(spark, tmp).collect()


def test_damaged_segments_are_reported(spark, tmpdir_fresh):
    parts = list(warc.page_records(5, "u", b"y" * 1200, None, "0-0", 300))
    assert len(parts) > 3
    good = archive(spark, parts[::-1], f"{tmpdir_fresh}/good")
    assert [(r.page_id, r.verified, r.payload_bytes) for r in good] == [(5, True, 1200)]
    gap = archive(spark, parts[:1] + parts[2:], f"{tmpdir_fresh}/gap")
    short = archive(spark, parts[:-1], f"{tmpdir_fresh}/short")
    orphan = archive(spark, parts[1:], f"{tmpdir_fresh}/orphan")
    assert [r.verified for r in gap + short + orphan] == [False] * 3


def test_registered_query_reassembles_ordinary_pages(spark, monkeypatch):
    paths, write = [], warc.write_archives

    def noted(*args, **options):
        paths.append(write(*args, **options))
        return paths[-1]
    monkeypatch.setattr(queries, "write_archives", noted)
    got = sorted(map(str, queries.op5_warc(spark, SF).collect()))
    raw = [bytes(r.content) for r in spark.read.format("binaryFile").load(paths[0]).collect()]
    heads = [h for b in raw for h, _ in warc.parse(b)]
    whole = [h for h in heads if h["warc-type"] == "response" and "warc-segment-number" not in h]
    cut = [h for h in heads if h["warc-type"] == "response" and "warc-segment-number" in h]
    assert len(cut) >= len(whole) and sum(h["warc-type"] == "continuation" for h in heads) >= len(cut)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = warc.read_archives(spark, write(pages, segment_bytes=1 << 30)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified").collect()
    assert got == sorted(map(str, plain)) and all(r.verified for r in plain)


def test_chunked_framing_in_any_pieces():
    payload = bytes(range(256)) * 400
    block = warc._HTTP + warc._chunked(payload)
    for step in (1, 7, 1000, len(block)):
        got = []
        body = warc.HttpBody(got.append)
        for i in range(0, len(block), step):
            body.feed(block[i:i + step])
        assert b"".join(got) == payload and body.whole
    body = warc.HttpBody(got.append)
    body.feed(block[:-3])
    assert not body.whole


# --- prefix tree -----------------------------------------------------------------

def test_escapes_are_reversible_and_leave_no_marks():
    for n in range(6):
        for x in itertools.product("<\\|a\n", repeat=n):
            text = "".join(x)
            assert prefix_tree.unescape(prefix_tree.escape(text)) == text
            assert "<|" not in prefix_tree.escape(text)
            role = prefix_tree.escape_role(text)
            assert prefix_tree.unescape_role(role) == text and "\n" not in role and "<|" not in role


def test_tree_shares_turns_and_attends_to_ancestors(spark):
    rng = random.Random(2)
    rows, talks = [], {}
    for c in range(120):
        turns = [("system", "S")] if c % 2 else []
        turns += [(("user", "assistant")[k % 2], rng.choice(["<|im_end|>", "a b", "é", "", "<\\|x"]))
                  for k in range(rng.randint(1, 6))]
        talks[c] = turns
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    talks[None] = [("", "null id"), ("assistant", "")]
    rows += [(None, None, None, "null id"), (None, 2, "assistant", None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("path", F.lit("clash"))
    tree = prefix_tree.build(table, TOKENIZER)
    nodes = {(r.tree, r.start): r for r in tree.nodes.collect()}
    prefixes = {tuple(t[:k]) for t in talks.values() for k in range(1, len(t) + 1)}
    assert len(nodes) == len(prefixes)
    total = sum(len(n.input_ids) for n in nodes.values())
    taken = sorted((n.tree + n.start, n.tree + n.start + len(n.input_ids)) for n in nodes.values())
    assert taken[0][0] == 0 and taken[-1][1] == total
    assert all(a[1] == b[0] for a, b in zip(taken, taken[1:]))  # one gap-free sequence
    voc = prefix_tree.Vocabulary(open(TOKENIZER, "rb").read()).load()
    for r in tree.conversations.collect():
        said, before, position = [], set(), 0
        for k, s in enumerate(r.starts):
            n = nodes[r.tree, s]
            assert n.depth == k and list(n.position_ids) == list(range(position, position + len(n.input_ids)))
            assert {i for a in n.attend for i in range(a.start, a.end)} == before
            before |= set(range(s, s + len(n.input_ids)))
            position += len(n.input_ids)
            said.append(voc.text(n.input_ids))
        want = talks[r.conv_id]
        assert "".join(said) == "".join(f"<|im_start|>{prefix_tree.escape_role(a)}\n{prefix_tree.escape(b)}<|im_end|>\n"
                                        for a, b in want)
        assert r.n_turns == len(want)
    got = {r.conv_id: r for r in prefix_tree.read_back(spark, tree, TOKENIZER).collect()}
    assert set(got) == set(talks)
    for c, want in talks.items():
        loss = "".join(b for a, b in want if a == "assistant")
        assert got[c].n_turns == len(want) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = prefix_tree.build(table.limit(0), TOKENIZER)
    assert prefix_tree.read_back(spark, empty, TOKENIZER).collect() == []


# --- language model --------------------------------------------------------------

def small_net(hidden=5, classes=4):
    net = Gru(np.array([30.0, 20, 9, 8, 7, 3, 2, 1]), 12.0, hidden=hidden, classes=classes)
    rng = np.random.default_rng(3)
    net.p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in net.p.items()}
    return net


def one_by_one(net, text):
    h, last, total = np.zeros((1, net.h)), 0, 0.0
    for y in text:
        h = net.gates(np.array([last]), h)[4]
        total += float(net.logp(h, np.array([y]))[0])
        last = y
    return total


def test_probabilities_sum_to_one():
    net = small_net()
    h = np.random.default_rng(4).normal(size=(1, net.h))
    assert abs(sum(float(np.exp(net.logp(h, np.array([y]))[0])) for y in range(net.m + 1)) - 1) < 1e-9
    fresh = Gru(np.array([30.0, 20, 9, 8, 7, 3, 2, 1]), 12.0)
    p = [float(np.exp(fresh.logp(np.zeros((1, fresh.h), np.float32), np.array([y]))[0])) for y in range(9)]
    mass = np.array([30, 20, 9, 8, 7, 3, 2, 1]) + 0.1
    assert np.allclose(p[:8], mass / (mass.sum() + 12), rtol=1e-4)


def test_state_runs_through_whole_texts_in_any_lanes():
    net = small_net()
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(1, 9, n), 0).astype(np.int32) for n in (0, 3, 50, 7, 0, 120, 1)]
    want = [one_by_one(net, t) for t in texts]
    for lanes in (1, 2, 5, 64):
        assert np.allclose(net.score(texts, lanes=lanes, rows=16), want, atol=1e-3)
    assert net.score([]).tolist() == []


def test_backpropagation_equals_finite_differences():
    net = small_net()
    texts = [np.array([3, 1, 2, 8, 5, 0]), np.array([4, 4, 6, 1, 7, 0])]
    grads = {}

    def catch(name, at, g, seen, rate):
        full = grads.setdefault(name, np.zeros(net.p[name].shape))
        full[at] += g
    net._step = catch
    net.train(texts, lanes=2, window=6)
    rng = np.random.default_rng(6)
    for name, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape)
            old, out = net.p[name][at], []
            for e in (1e-5, -1e-5):
                net.p[name][at] = old + e
                out.append(-sum(one_by_one(net, t) for t in texts) / len(texts))
            net.p[name][at] = old
            assert abs((out[0] - out[1]) / 2e-5 - g[at]) < 1e-3 + 1e-2 * abs(g[at]), (name, at)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(7)
    texts = [np.append(np.arange(n) % 7 + 1, 0).astype(np.int32) for n in rng.integers(5, 60, 200)]
    counts = np.bincount(np.concatenate(texts), minlength=8).astype(float)
    net = Gru(counts, 1.0)
    before = net.score(texts).sum()
    for _ in range(3):
        net.train(texts)
    assert net.score(texts).sum() > 0.5 * before


def test_every_token_of_every_lane_is_trained():
    rng = np.random.default_rng(9)
    for sizes, lanes in (((37, 20, 5, 3), 4), ((1, 2, 3), 2), ((16, 16, 32), 3), ((70,), 64)):
        texts = [np.append(rng.integers(1, 8, n - 1), 0).astype(np.int32) for n in sizes]
        net, learnt = small_net(), []
        output = net._output
        net._output = lambda h, y: learnt.extend(y.tolist()) or output(h, y)
        assert net.train(texts, lanes=lanes) == sum(sizes)
        assert sorted(learnt) == sorted(np.concatenate(texts).tolist())


def test_gradients_of_lanes_that_end_inside_a_window():
    net, grads = small_net(), {}
    texts = [np.array([3, 1, 2, 8, 5, 0]), np.array([4, 4, 0]), np.array([0])]

    def catch(name, at, g, seen, rate):
        full = grads.setdefault(name, np.zeros(net.p[name].shape))
        full[at] += g
    net._step = catch
    net.train(texts, lanes=3, window=6)
    rng = np.random.default_rng(6)
    for name, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape)
            old, out = net.p[name][at], []
            for e in (1e-5, -1e-5):
                net.p[name][at] = old + e
                out.append(-sum(one_by_one(net, t) for t in texts) / len(texts))
            net.p[name][at] = old
            assert abs((out[0] - out[1]) / 2e-5 - g[at]) < 1e-3 + 1e-2 * abs(g[at]), (name, at)


def test_every_training_document_reaches_the_network_once(spark, monkeypatch, tmp_path):
    texts_of, folder = language_model.texts_of, str(tmp_path)

    def noted(w, number, other):  # runs in the Python workers
        texts = texts_of(w, number, other)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(" ".join(map(str, t.tolist())) for t in texts))
        return texts
    monkeypatch.setattr(language_model, "texts_of", noted)
    rows = [(i, f"a w{i} a") for i in range(150)] + [(None, "a b"), (900, None), (7, "a w7 a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [b"", b"a", b"b", *(b"w%d" % i for i in range(150))]
    language_model.train(docs, (pa.array(words, pa.binary()), np.ones(len(words), np.int64)), 1.0)
    got = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")]
    number = {w: i for i, w in enumerate(words)}
    assert sorted(got) == sorted(" ".join(str(number[w]) for w in [*(t or "").encode().split(), b""]) for _, t in rows)


def test_scores_of_documents(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 30)
    monkeypatch.setattr(language_model, "WORDS", 10)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["The", "of", "Été", "x"]) if rng.random() < .6 else f"t{rng.randrange(80)}"
                         for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, " \n"), (None, "the of"), (5, rows[5][1]), (302, "never seen words here " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("c", F.lit(2))
    got = language_model.score(docs).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = {}
    for i, t in rows:
        if not out(i):
            for w in [*lower_words(t), b""]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = [*lower_words(t), b""]
        want.append((i, out(i), len(w), sum(x in count for x in w), n, round(sum(
            np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in got), key=str) == sorted(want, key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > 1.2 * sum(r.base_score for r in got)
    assert language_model.score(docs.limit(0)).collect() == []


@pytest.mark.parametrize("ids", [[], [7]])
def test_scores_without_training_documents(spark, ids):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:len(ids)]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = language_model.score(docs).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in got] == [(True, 0, 0)] * len(held)
    assert all(np.isfinite(r.score) for r in got)


def test_encoded_texts_are_whole_and_in_their_share(spark):
    rows = [(i, "b " * (i % 5) + f"x{i} a") for i in range(60)] + [(None, "a b"), (5, None), (6, ""), (7, "a " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [b"", b"a", b"b"]
    number = {w: i for i, w in enumerate(words)}
    got = [(r.share, text) for r in language_model.encode(docs, words, 2).collect()
           for text in bytes(r.ids).hex(" ", 2).split("0000")[:-1]]
    want = []
    for i, t in rows:
        share = 0 if i is None else zlib.crc32(str(i).encode()) // 10 % language_model.SHARE
        want.append((share, [number.get(w, 3) for w in (t or "").encode().split()]))
    assert sorted((s, [int(x[:2], 16) for x in text.split()]) for s, text in got) == sorted(want)


def test_long_texts_are_learnt_in_stretches_with_the_word_before():
    texts = [np.append(np.arange(2500) % 7 + 1, 0).astype(np.int32), np.array([0], np.int32)]
    parts, before = stretches(texts, 1024)
    assert [len(p) for p in parts] == [1024, 1024, 453, 1]
    assert np.array_equal(np.concatenate(parts), np.concatenate(texts))
    assert before.tolist() == [0, texts[0][1023], texts[0][2047], 0]
    net, learnt = small_net(), []
    output = net._output
    net._output = lambda h, y: learnt.extend(y.tolist()) or output(h, y)
    assert net.train(texts, lanes=3) == 2502
    assert sorted(learnt) == sorted(np.concatenate(texts).tolist())


def test_runs_of_millions_of_equal_characters(spark):
    texts = [" " * 3_000_000, "x" * 2_000_000 + " end", "7" * 2_000_000, "\u00e9" * 5000 + "<|im_end|>" * 1000, "a" * 4096]
    table = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)],
                                  "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in prefix_tree.read_back(spark, prefix_tree.build(table, TOKENIZER), TOKENIZER).collect()}
    for i, t in enumerate(texts):
        assert got[i].turns_sha256 == hashlib.sha256(f"assistant\n{t}\n".encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(t.encode()).hexdigest()

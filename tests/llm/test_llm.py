"""Sketches, top N, tokenizer, packing and abuse scores against brute force, libraries and planted cases."""

from __future__ import annotations

import random
import time
from decimal import Decimal

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import abuse, packing, quantiles, tokenizer, topn


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- quantiles ----------------------------------------------------------------------------------


def ranks_within(own, value, q):
    low, high = np.searchsorted(own, value, "left"), np.searchsorted(own, value, "right")
    room = quantiles.rank_error() * len(own) + 1
    return low - room <= q * len(own) <= high + room


def test_sketches_merge_within_the_bound(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(2, 2, 30_000), np.full(20_000, 3), rng.integers(0, 10, 10_000)]).astype(np.int64)
    data = [("hot" if i % 3 else f"g{i % 50}", i % 40, int(v)) for i, v in enumerate(values)] + [("nulls", 1, None), (None, 2, 7)]
    df = spark.createDataFrame(data, "g string, day int, v long")
    merged = quantiles.merged(quantiles.sketches(df, ["g", "day"], ["v"]), [["g"], ["day"]])
    by = {}
    for g, d, v in data:
        if v is not None:
            by.setdefault(("g", g), []).append(v)
            by.setdefault(("day", d), []).append(v)
    seen = 0
    for r in merged.select("level", "g", "day", "n", *[quantiles.whole_percentile("sketch", q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)]).collect():
        own = np.sort(by[r["level"], r["g"] if r["level"] == "g" else r["day"]])
        assert r["n"] == len(own)
        assert all(ranks_within(own, r[f"q{int(q * 100)}"], q) for q in (0.1, 0.5, 0.9))
        seen += 1
    assert seen == len(by)
    assert rows(quantiles.sketches(df.where("false"), ["g"], ["v"])) == []


def test_fractions_stay_fractions(spark):
    rng = np.random.default_rng(4)
    values = rng.random(8000) * 0.3
    data = [(float(v), float(np.float32(v)), Decimal(f"{v:.4f}"), i) for i, v in enumerate(values)] + [(None, float("nan"), None, None), (float("nan"), None, None, None)]
    df = spark.createDataFrame(data, "x double, f float, d decimal(10,4), i int").withColumn("g", F.lit("a"))
    made = quantiles.merged(quantiles.sketches(df, ["g"], ["x", "f", "d", "i"]), [["g"]])
    got = {r["measure"]: r for r in made.select("measure", "kind", "n", quantiles.percentile("sketch", 0.5).alias("p")).collect()}
    assert {m: (r["kind"], r["n"]) for m, r in got.items()} == {"x": ("double", 8000), "f": ("double", 8000), "d": ("double", 8000), "i": ("bigint", 8000)}
    for m, scale in (("x", 1.0), ("f", 1.0), ("d", 1.0)):
        assert 0.1 < got[m]["p"] < 0.2 and ranks_within(np.sort(values) * scale, got[m]["p"], 0.5)
    small = spark.createDataFrame([("a", n / 1000) for n in range(300)], "g string, v double")
    assert quantiles.sketches(small, ["g"], ["v"]).select(quantiles.percentile("sketch", 0.5)).first()[0] == 0.149
    with pytest.raises(TypeError):
        quantiles.sketches(df, ["g"], ["g"])
    with pytest.raises(Exception, match="another kind"):
        quantiles.merged(quantiles.sketches(df, ["g"], ["x"]), [["g"]], kinds=("bigint",)).collect()


def test_stored_days_merge_by_range(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 20).alias("day"), ((F.col("id") * 7919) % 20_000).alias("v"))
    quantiles.sketches(df, ["day"], ["v"]).write.parquet(str(tmp_path / "days"))
    part = spark.read.parquet(str(tmp_path / "days")).where("day < 8")
    made = quantiles.merged(part, [[]]).select("n", quantiles.whole_percentile("sketch", 0.5)).first()
    own = np.sort([(i * 7919) % 20_000 for i in range(20_000) if i % 20 < 8])
    assert made[0] == len(own) and ranks_within(own, made[1], 0.5)


def test_bound_and_confidence():
    assert abs(quantiles.rank_error(400, 0.99) - 0.0103) < 1e-4
    assert quantiles.rank_error() < 0.01 and quantiles.rank_error(confidence=0.99) < quantiles.rank_error()


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 102)], "g string, v long")
    made = quantiles.sketches(df, ["g"], ["v"]).select(quantiles.whole_percentile("sketch", 0.5)).first()[0]
    assert made == 51


# --- top n --------------------------------------------------------------------------------------


def test_top_items_against_brute_force(spark):
    rng = random.Random(2)
    data = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.4 else rng.choice([None, *[f"g{k}" for k in range(60)]])
        data.append((group, rng.choice([None, 1, 1, 1, 2, 3, 500, rng.randrange(100)]), rng.choice([None, "a", "b", "Z", "é"]), f"id{i:05d}", i))
    df = spark.createDataFrame(data, "g string, score int, name string, id string, _band int").withColumns({"rank_no": F.lit("x"), "_HAVE": F.lit(1), "_filled": F.lit(None).cast("string")})
    expected = []
    for g in {d[0] for d in data} - {None}:
        own = sorted((d for d in data if d[0] == g and d[1] is not None), key=lambda d: (-d[1], d[2] is None, (d[2] or "").encode(), d[3]))
        expected += [(g, n + 1, d[3]) for n, d in enumerate(own[:5])]
    ties = [F.col("name").asc_nulls_last(), F.col("id").asc()]
    for shares in ((0.03, 0.15, 0.5), (0.5,), ()):
        assert rows(topn.top_items(df, "g", "score", ties, 5, shares), "g", "rank_no", "id") == sorted(expected, key=repr)
    assert rows(topn.top_items(df.where("false"), "g", "score", ties, 5)) == []
    assert rows(topn.top_items(df.withColumn("score", F.lit(1)), "g", "score", ties, 1), "rank_no")[0] == (1,)


def test_many_items_of_a_hot_group(spark):
    rng = random.Random(8)
    data = [("hot" if i % 4 else f"g{i % 12}", rng.randrange(40), i) for i in range(6000)] + [(None, 1, -1), ("x", None, -2)]
    df = spark.createDataFrame(data, "g string, score int, id int")
    expected = []
    for g in {d[0] for d in data} - {None}:
        own = sorted((d for d in data if d[0] == g and d[1] is not None), key=lambda d: (-d[1], d[2]))
        expected += [(g, n + 1, d[2]) for n, d in enumerate(own[:1200])]
    assert rows(topn.top_items(df, "g", "score", [F.col("id").asc()], 1200), "g", "rank_no", "id") == sorted(expected, key=repr)
    odd = spark.createDataFrame([(0,)], "score int").where("false")  # edges from elsewhere change nothing
    assert rows(topn.top_items(df, "g", "score", [F.col("id").asc()], 1200, scores=odd), "g", "rank_no", "id") == sorted(expected, key=repr)


# --- tokenizer ----------------------------------------------------------------------------------

BPE = tokenizer.tokenizer(tokenizer.vocabulary())
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizer.SPLIT, mergeable_ranks=BPE.ranks, special_tokens={})
ODD = ["", " ", "\n\n\t ", "<|endoftext|>", "[CLS] a [SEP]", "naïve café\r\n", "日本語のテキスト", "👩‍👩‍👧 é ​﻿", "don't we'LL", "x" * 5000, "ab" * 700 + "é" * 400, "１２３ 456", "\u0000a\u0000", "the the the"]


@pytest.mark.parametrize("text", ODD)
def test_encoding_equals_the_library(text):
    assert BPE.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(text):
    ids = BPE.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert REFERENCE.decode_bytes(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_scan_and_queue_agree(data):
    assert BPE._by_scan(data) == BPE._by_queue(data)


def test_encode_texts(spark):
    data = [(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (3, "hello world", "d"), (None, "x", "e")]
    df = spark.createDataFrame(data, "doc_id long, text string, key string")
    coded = tokenizer.encode_texts(df, "doc_id", "text")
    assert coded.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert rows(coded) == sorted([(k, REFERENCE.encode_ordinary(t) if t else []) for k, t, _ in data], key=repr)
    assert rows(tokenizer.count_tokens(df, "doc_id", "text"), "tokens") == [(0,), (0,), (1,), (2,), (2,)]
    assert rows(tokenizer.encode_texts(df.where("false"), "doc_id", "text")) == []


# --- packing ------------------------------------------------------------------------------------


def best_by_definition(open_bins: list[int], size: int, capacity: int) -> set[int]:
    """The rooms whose choice makes the sum of squared counts smallest, by recounting all."""
    costs = {}
    for room in {*[r for r in open_bins if r >= size], capacity}:
        after = list(open_bins)
        if room < capacity or capacity in open_bins:
            after.remove(room)
        after.append(room - size)
        counts = {r: after.count(r) for r in set(after) if 0 < r < capacity}
        costs[room] = sum(c * c for c in counts.values())
    return {r for r, c in costs.items() if c == min(costs.values())}


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 20), st.data())
def test_sum_of_squares_rule(capacity, data):
    packer, rooms = packing.SumOfSquares(capacity), {}
    for size in data.draw(st.lists(st.integers(1, capacity), max_size=40)):
        allowed = best_by_definition([r for r in rooms.values() if r], size, capacity)
        chosen = packer.place(size)
        assert rooms.get(chosen, capacity) in allowed
        rooms[chosen] = rooms.get(chosen, capacity) - size
        assert rooms[chosen] >= 0


def test_pack(spark):
    rng = random.Random(4)
    sizes = [rng.choice([None, 0, 1, 7, 63, 64, 65, 200, rng.randrange(1, 60)]) for _ in range(2000)]
    df = spark.createDataFrame([(i % 1500, s, 1) for i, s in enumerate(sizes)], "doc_id long, tokens int, block int")
    packed = packing.pack(df, "doc_id", "tokens", [(1, 64), (2, 500)], len(sizes), 600).collect()
    for capacity_id, capacity in ((1, 64), (2, 500)):
        own = [r for r in packed if r["capacity_id"] == capacity_id]
        held, pieces = {}, {}
        for r in own:
            held[r["block"], r["container"]] = held.get((r["block"], r["container"]), 0) + r["tokens"]
            pieces.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(held.values()) <= capacity
        assert sum(held.values()) == sum(s or 0 for s in sizes)
        want = {}
        for i, s in enumerate(sizes):
            whole, rest = divmod(s or 0, capacity)
            want.setdefault(i % 1500, []).extend([capacity] * whole + ([rest] if rest or not whole else []))
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
        assert len(held) <= 1.05 * -(-sum(s or 0 for s in sizes) // capacity) + 8
    assert rows(packing.pack(df.where("false"), "doc_id", "tokens", [(1, 64)], 0)) == []
    for wrong in ([(1, 0)], []):
        with pytest.raises(ValueError):
            packing.pack(df, "doc_id", "tokens", wrong, 5)


def test_placement_depends_on_the_items_alone(spark):
    rng = random.Random(5)
    data = [(7 if i % 3 == 0 else i, 5 if i % 3 == 0 else rng.choice([None, 0, 3, 9, 70]), "x") for i in range(9000)] + [(None, 4, "y"), (None, None, "y")]
    df = spark.createDataFrame(data, "doc_id long, tokens int, block string")
    pairs = [(1, 64), (2, 64), (3, 100)]
    one = rows(packing.pack(df.repartition(2), "doc_id", "tokens", pairs, len(data), 500))
    assert rows(packing.pack(df.repartition(5, "tokens"), "doc_id", "tokens", pairs, len(data), 500)) == one
    assert rows(packing.pack(df.orderBy(F.rand(3)), "doc_id", "tokens", pairs, len(data), 500)) == one
    hot = [r for r in one if r[0] == 1 and r[3] == 7]
    assert len(hot) == 3001 and len({r[1] for r in hot}) >= 2  # equal items lie in several blocks
    assert [r[1:] for r in one if r[0] == 1] == [r[1:] for r in one if r[0] == 2]


def test_many_capacities(spark):
    df = spark.createDataFrame([(i, i % 9) for i in range(50)], "doc_id long, tokens int")
    assert packing.pack(df, "doc_id", "tokens", [(n, 10 + n) for n in range(100)], 50).select("capacity_id").distinct().count() == 100


# --- abuse --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [("W0RTHLE$5", "worthless"), ("i.d.i.o.t", "idiot"), ("M-i-s-t", "mist"), ("ssssstupid", "stupid"), ("mоrоn", "moron"), ("l@zy verm1n", "lazy vermin"), ("d u m b", "dumb"), ("ｉｄｉｏｔ", "idiot"), ("id​iot", "idiot"), ("pr*ck", "pr*ck")],
)
def test_words_without_disguise(disguised, plain):
    assert list(abuse.words_of(disguised)) == plain.split()


def test_placeholders_and_sentences():
    assert abuse.words_of("[10:01] @abc: see /src/a.go, run 12c5e731, @xyz fixed load_index and parseIndex 15 times") == tuple("see <path> run <hash> <user> fixed <name> and <name> <num> times".split())
    assert len(abuse.split_sentences("One. Two! 三。四\nFive e.g.x")) == 5
    assert abuse.split_sentences("") == [] and abuse.words_of("  ") == ()


@pytest.mark.parametrize("text", ["Ab3" * 60_000, "x" * 60_000 + "1*", "a.b" * 60_000, "1a" * 60_000, "(" * 60_000, "@" * 60_000, "- " * 60_000, "/a" * 60_000, "e\u0301" * 60_000, "a b " * 30_000, "\u597d" * 60_000])
def test_long_texts_without_sentences(text):
    began = time.perf_counter()
    assert isinstance(abuse.words_of(text), tuple)
    assert abuse.Model({}).document(text)[0] < 0.05
    assert time.perf_counter() - began < 30


def labelled():
    rng = random.Random(9)
    rude = ["you {} {}, go away", "what a {} {} you are", "shut up you {} {}"]
    mild = ["the {} {} returns early", "please split the {} {} first", "closed as a {} {} duplicate", "my {} {} mistake, sorry"]
    adjectives, nouns = ["lazy", "stupid", "worthless", "dumb"], ["clown", "pig", "loser", "moron"]
    texts, truth = [], []
    for _ in range(500):
        bad = rng.random() < 0.3
        sentences = [rng.choice(mild).format(rng.choice(adjectives), rng.choice(["parser", "cache", "loop"])) for _ in range(rng.randrange(1, 6))]
        if bad:
            sentences.insert(rng.randrange(len(sentences) + 1), rng.choice(rude).format(rng.choice(adjectives), rng.choice(nouns)))
        texts.append(". ".join(sentences))
        truth.append(bad)
    flipped = [t != (rng.random() < 0.05) for t in truth]
    return texts, np.array(truth), np.array(flipped, float)


def test_model_learns_sentences_from_documents():
    texts, truth, votes = labelled()
    model = abuse.Model.loads(abuse.fit(texts[:400], votes[:400], 1 - votes[:400], steps=60).dumps())
    found = np.array([model.document(t)[0] > 0.5 for t in texts[400:]])
    assert (found == truth[400:]).mean() > 0.95
    score, at, worst = model.document("the lazy cache returns early. you stupid pig, go away. closed as a dumb loop duplicate")
    assert at == 1 and score >= worst > 0.5
    assert model.document(None) == (0.0, -1, 0.0) == model.document(" \n")


def test_length_alone_raises_no_suspicion():
    texts, truth, votes = labelled()
    model = abuse.fit(texts[:400], votes[:400], 1 - votes[:400], steps=60)
    unknown = abuse.Model({})
    assert abs(unknown.document("alpha beta. gamma")[0] - unknown.document(". ".join(f"w{i} x{i}" for i in range(5000)))[0]) < 0.01
    assert model.document(". ".join(f"the value{i} returns early" for i in range(2000)))[0] < 0.5
    bad = "you stupid pig, go away"
    assert model.document(bad)[0] > 0.5 and model.document(". ".join([bad] * 50))[0] == model.document(bad)[0]
    assert model.document(". ".join([*(f"closed as a slow loop{i} duplicate" for i in range(30)), bad]))[1] == 30


def test_columns_that_always_meet_count_several_times():
    texts, _, votes = labelled()
    bags = abuse._Bags()
    for t in texts[:60]:
        bags.add(t)
    bags.close()
    assert bags.times.sum() == len(bags.names) == len(bags.group) and len(bags.times) < len(bags.names)
    rng = np.random.default_rng(0)
    weight = rng.normal(size=len(bags.times))
    model = abuse.Model({int(n): float(w) for n, w in zip(bags.names, weight[bags.group], strict=True)})
    clean = np.exp(-bags.totals(weight, abuse.BIAS, abuse.LENGTH)[1])
    assert np.allclose(1 - clean, [d[0] for d in model.documents(texts[:60])])


def test_sample_is_bounded(spark):
    texts, _, votes = labelled()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(600, "x" * (2 << 20))], "doc_id long, text string")
    opinions = spark.createDataFrame([(i, int(v), int(1 - v)) for i, v in enumerate(votes)] + [(600, 1, 0)], "doc long, votes_for long, votes_against long")
    for bounds in ({"most": 50}, {"most_bytes": 5000}, {"most": 0}):
        assert isinstance(abuse.train(df, opinions, "doc_id", "text", **bounds), abuse.Model)
    assert abuse.train(df, opinions, "doc_id", "text", most=0).weights == {}


def test_fit_without_labels():
    model = abuse.fit([], np.zeros(0), np.zeros(0))
    assert model.weights == {} and model.document("anything")[0] < 0.1


def test_score_rates_and_votes(spark):
    texts, _, votes = labelled()
    labels = [(i, f"r{i % 3}", "ABUSIVE " if v else " ok", 1) for i, v in enumerate(votes[:300])] + [(0, "r9", None, 1), (1, "r9", "unsure", 1), (None, "r1", "ok", 1), (5, "x", "ok", 1), (5, "x", "abusive", 2)]
    df = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(9000, None, None), (9001, "", None)], "doc_id long, text string, source string")
    opinions = abuse.votes(spark.createDataFrame(labels, "doc_id long, reviewer string, label string, at int"), "doc_id", "reviewer", "label", "at")
    five = opinions.where("doc = 5").first()
    assert five["votes_for"] + five["votes_against"] == 2 and opinions.where("doc is null").count() == 0
    model = abuse.train(df, opinions, "doc_id", "text")
    scored = abuse.score(df, "doc_id", "text", model)
    assert scored.count() == len(texts) + 2
    assert rows(scored.where("doc_id >= 9000"), "score", "sentence_no", "sentence") == [(0.0, -1, None)] * 2
    assert {r["source"]: r["documents"] for r in abuse.rates(scored, "source").collect()} == {"s0": 250, "s1": 250, None: 2}
    assert abuse.score(df.where("false"), "doc_id", "text", model).count() == 0
    assert abuse.train(df, opinions.where("false"), "doc_id", "text").weights == {}
